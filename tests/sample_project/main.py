from shop.api import list_items
import shop


def main():
    list_items()
