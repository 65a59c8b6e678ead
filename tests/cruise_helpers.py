"""Small helpers of the library's tests."""

import datetime as dt


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)
