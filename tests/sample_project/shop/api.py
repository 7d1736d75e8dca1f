import os
from shop.store import load_items


@app.get("/items")
def list_items():
    return load_items()
