"""Technical indicators as panel expressions.

Each function returns named expression texts for plans.expression.
"""

from __future__ import annotations

C, H, L, O, V = "$close", "$high", "$low", "$open", "$volume"  # noqa: E741


def macd(short: int = 12, long: int = 26, mid: int = 9) -> dict[str, str]:
    """Difference of two exponential means, its signal line, and twice their gap."""
    dif = f"(EMA({C}, {short}) - EMA({C}, {long}))"
    dea = f"EMA({dif}, {mid})"
    return {"macd_dif": dif, "macd_dea": dea, "macd": f"2 * ({dif} - {dea})"}


def boll(n: int = 20, k: float = 2) -> dict[str, str]:
    mid, dev = f"Mean({C}, {n})", f"{k} * Std({C}, {n})"
    return {"boll_mid": mid, "boll_up": f"{mid} + {dev}", "boll_low": f"{mid} - {dev}"}


def rsi(n: int = 14) -> dict[str, str]:
    """Relative strength by exponential means of gains and losses (gains are the elementwise maximum of the change and 0)."""
    change = f"({C} - Ref({C}, 1))"
    up, down = (f"EMA(Greater({x}, 0), {2 * n - 1})" for x in (change, f"0 - {change}"))
    return {f"rsi_{n}": f"100 - 100 / (1 + {up} / {down})"}


def kdj(n: int = 9, m1: int = 3, m2: int = 3) -> dict[str, str]:
    low = f"Min({L}, {n})"
    k = f"EMA(({C} - {low}) / (Max({H}, {n}) - {low}) * 100, {2 * m1 - 1})"
    d = f"EMA({k}, {2 * m2 - 1})"
    return {"kdj_k": k, "kdj_d": d, "kdj_j": f"3 * {k} - 2 * {d}"}


def dmi(n: int = 14) -> dict[str, str]:
    """Directional movement: both indices, their index, its mean and the mean of that with its own past."""
    span = 2 * n - 1
    true_range = f"Greater(Greater({H} - {L}, Abs({H} - Ref({C}, 1))), Abs({L} - Ref({C}, 1)))"
    up, down = f"({H} - Ref({H}, 1))", f"(Ref({L}, 1) - {L})"
    plus = f"If(And({up} > 0, {up} > {down}), {up}, 0)"
    minus = f"If(And({down} > 0, {down} > {up}), {down}, 0)"
    pdi, mdi = (f"(EMA({x}, {span}) / EMA({true_range}, {span}) * 100)" for x in (plus, minus))
    dx = f"(Abs({pdi} - {mdi}) / ({pdi} + {mdi}) * 100)"
    adx = f"EMA({dx}, {span})"
    return {"pdi": pdi, "mdi": mdi, "dx": dx, "adx": adx, "adxr": f"({adx} + Ref({adx}, {n})) / 2"}


def wr(n: int = 10) -> dict[str, str]:
    return {f"wr_{n}": f"(Max({H}, {n}) - {C}) / (Max({H}, {n}) - Min({L}, {n})) * 100"}


def bias(n: int = 12) -> dict[str, str]:
    return {f"bias_{n}": f"({C} - Mean({C}, {n})) / Mean({C}, {n}) * 100"}


def cci(n: int = 20) -> dict[str, str]:
    typical = f"(({H} + {L} + {C}) / 3)"
    return {f"cci_{n}": f"({typical} - Mean({typical}, {n})) / (0.015 * Mean(Abs({typical} - Mean({typical}, {n})), {n}))"}


def roc(n: int = 12) -> dict[str, str]:
    return {f"roc_{n}": f"({C} - Ref({C}, {n})) / Ref({C}, {n}) * 100"}


def registry() -> dict[str, str]:
    """Label, moving average and all indicators in their usual settings."""
    out = {"label": f"Ref({C}, -2) / Ref({C}, -1) - 1", "ma5": f"Mean({C}, 5)"}
    for part in (macd(), boll(), *(rsi(n) for n in (6, 12, 14, 24)), kdj(), dmi(), wr(), *(bias(n) for n in (6, 12, 24)), cci(), roc()):
        out |= part
    return out
