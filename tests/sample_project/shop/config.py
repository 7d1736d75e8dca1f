LIMIT = 3


def limit() -> int:
    return LIMIT
