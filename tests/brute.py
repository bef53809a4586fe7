"""The feature definitions, second by second, in plain Python."""

from __future__ import annotations

import math

EPS = 1e-8


def bucket(book: dict[int, tuple], trade: dict[int, tuple]) -> list[dict]:
    """Rows 0..599 from ``{second: (bid, ask, bid_size, ask_size)}`` and ``{second: (size, orders)}``."""
    rows, wap = [], None
    spread = mid = imbalance = wap_second = trade_second = previous = None
    squares, orders = [], []
    for s in range(600):
        quote = book.get(s, (None,) * 4)
        bid, ask, bid_size, ask_size = quote
        if None not in quote:
            wap = (bid * ask_size + ask * bid_size) / (bid_size + ask_size + EPS)
            wap_second = s
        if bid is not None and ask is not None:
            spread, mid = ask - bid, (ask + bid) / 2
        if bid_size is not None and ask_size is not None:
            imbalance = (bid_size - ask_size) / (bid_size + ask_size + EPS)
        size, order_count = trade.get(s, (None, None))
        if size is not None:
            trade_second = s
        level = math.log(wap) if wap is not None and wap > 0 else None
        move = level - previous if level is not None and previous is not None else 0.0
        previous = level
        squares.append(move * move)
        orders.append(order_count or 0)
        stale = min(s - trade_second if trade_second is not None else s + 1, 15)
        rows.append(
            {
                "size": size or 0,
                "order_count": order_count or 0,
                "wap_last": wap,
                "seconds_since_last_wap": min(s - wap_second if wap_second is not None else s + 1, 15),
                "log_return": move,
                "rv_30s": math.sqrt(sum(squares[-30:])),
                "rv_120s": math.sqrt(sum(squares[-120:])),
                "spread_last": spread,
                "mid_last": mid,
                "rel_spread_last": spread / (mid + EPS) if spread is not None else None,
                "ofi_last": imbalance,
                "seconds_since_last_trade": stale,
                "last_trade_gap_geq_cap": int(stale >= 15),
                "order_intensity_60s": sum(orders[-60:]),
            }
        )
    return rows
