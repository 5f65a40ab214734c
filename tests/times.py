"""Moments that tests count from."""

import datetime as dt

T0 = dt.datetime(2026, 1, 1, 12, 0, 0)


def minutes(n: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=n)
