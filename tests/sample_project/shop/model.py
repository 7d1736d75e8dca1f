from shop.config import limit


class Item:
    def price(self, n) -> float:
        if n > limit():
            return 1.0
        return 2.0


def orphan_helper(x):
    return x
