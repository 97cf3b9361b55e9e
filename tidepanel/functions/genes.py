"""The library of expression factors.

``composites`` are stated one by one; the price-volume family is built from its
rule for any list of windows.
"""

from __future__ import annotations

WINDOWS = (5, 10, 20, 30, 60)

# Expressions that must equal the published factor definitions.
COMPOSITES = {
    "LOWPOS_SHARPE_COV": "Cov($low/$close, EMA($close/Ref($close,1)-1, 20)/Std($close/Ref($close,1)-1, 20), 20)",
    "CANDLE_SHADOW_P3": "EMA(Power(($close-$open)/$open + ($high-Greater($open,$close))/$open, 3), 20)",
    "RETCHG_MINUS_GAP": "EMA(($close/Ref($close,1)-1)*($volume/Ref($volume,1)-1) - ($open-Ref($close, 1)) / (Ref($close, 1) + 1e-12), 20)",
    "PRICE_AMPLITUDE_EFF": "Div(Div($close, Add(Max($high, 5), 1e-12)), Div(Sub($high, $low), Add($open, 1e-12)))",
    "AMPLITUDE_MAD17": "Mad(Div(Sub($high, $low), Add($open, 1e-12)), 17)",
    "DUAL_RISK_RESONANCE": "Add(Mul(Div($close, Add(WMA($close, 20), 1e-12)), Div(Std($close, 5), Add(Std($close, 20), 1e-12))), Mul(Div(Sub($high, $low), Add($open, 1e-12)),Std($volume, 5)))",
    "VOLPRICE_COV_AMP": "Mul(Cov(Div($close, Ref($close, 1)), Sub($volume, Ref($volume, 1)), 20), Div(Sub($high, $low), $close))",
    "RET_VAR_11": "Var(Div($close, Ref($close, 1)), 11)",
    "AMP_HIGHVOL_RESONANCE": "Mul(Div(Sub($high, $low), $close), Div(Std($high, 20), $close))",
    "LOWPOS_VAR_27": "Var(Div($low, $close), 27)",
    "RETVOL_VOLRATIO": "Mul(Std(Div($close, Ref($close, 1)), 20), Div($volume, Mean($volume, 5)))",
    "SURGE2_RETVOL": "Mul(Power(Div($volume, EMA($volume, 20)), 2.0), Std(Div($close, Ref($close, 1)), 10))",
    "INTRADAY_RETVAR_27": "Var(Abs(Div(Sub($close, $open), $open)), 27)",
    "LOWPOS_CUMSUM": "Sum(WMA(Div($low, $close), 9), 17)",
    "VOLRATIO_LOWPOS_COV": "Cov(Div($volume, EMA($volume, 20)), Div($low, $close), 20)",
    "KMID": "Div(Sub($close, $open), $open)",
    "KLEN": "Div(Sub($high, $low), $open)",
    "KMID2": "Div(Sub($close, $open), Add(Sub($high, $low),1e-12))",
    "KUP": "Div(Sub($high, Greater($open, $close)), $open)",
    "KUP2": "Div(Sub($high, Greater($open, $close)), Add(Sub($high, $low),1e-12))",
    "KLOW": "Div(Sub(Less($open, $close), $low), $open)",
    "KLOW2": "Div(Sub(Less($open, $close), $low), Add(Sub($high, $low),1e-12))",
    "KSFT": "Div(Sub(Add($close, $close), Add($high, $low)), $open)",
    "KSFT2": "Div(Sub(Sub(Mul(2.0, $close), $high), $low), Add(Sub($high, $low),1e-12))",
}

# One expression per family, {n} being the window.
FAMILIES = {
    "ROC": "Div(Ref($close, {n}), $close)",
    "MA": "Div(Mean($close, {n}), $close)",
    "STD": "Div(Std($close, {n}), $close)",
    "BETA": "Div(Slope($close, {n}), $close)",
    "RSQR": "Rsquare($close, {n})",
    "RESI": "Div(Resi($close, {n}), $close)",
    "MAX": "Div(Max($high, {n}), $close)",
    "MIN": "Div(Min($low, {n}), $close)",
    "QTLU": "Div(Quantile($close, {n}, 0.8), $close)",
    "QTLD": "Div(Quantile($close, {n}, 0.2), $close)",
    "RANK": "Rank($close, {n})",
    "RSV": "Div(Sub($close, Min($low, {n})), Add(Sub(Max($high, {n}), Min($low, {n})), 1e-12))",
    "IMAX": "Div(IdxMax($high, {n}), {n}.0)",
    "IMIN": "Div(IdxMin($low, {n}), {n}.0)",
    "CORR": "Corr($close, Log(Add($volume, 1.0)), {n})",
    "CORD": "Corr(Div($close, Ref($close, 1)), Log(Add(Div($volume, Ref($volume, 1)), 1.0)), {n})",
    "CNTP": "Mean(Gt($close, Ref($close, 1)), {n})",
    "CNTN": "Mean(Lt($close, Ref($close, 1)), {n})",
    "SUMP": "Div(Sum(Greater(Sub($close, Ref($close, 1)), 0.0), {n}), Add(Sum(Abs(Sub($close, Ref($close, 1))), {n}), 1e-12))",
    "SUMN": "Div(Sum(Greater(Sub(Ref($close, 1), $close), 0.0), {n}), Add(Sum(Abs(Sub($close, Ref($close, 1))), {n}), 1e-12))",
    "VMA": "Div(Mean($volume, {n}), Add($volume, 1e-12))",
    "VSTD": "Div(Std($volume, {n}), Add($volume, 1e-12))",
    "VSUMP": "Div(Sum(Greater(Sub($volume, Ref($volume, 1)), 0.0), {n}), Add(Sum(Abs(Sub($volume, Ref($volume, 1))), {n}), 1e-12))",
    "VSUMN": "Div(Sum(Greater(Sub(Ref($volume, 1), $volume), 0.0), {n}), Add(Sum(Abs(Sub($volume, Ref($volume, 1))), {n}), 1e-12))",
}

# The rest of the published 158 features, {n} being the window.
PRICES = {"OPEN0": "Div($open, $close)", "HIGH0": "Div($high, $close)", "LOW0": "Div($low, $close)"}
MORE_FAMILIES = {
    "IMXD": "Div(Sub(IdxMax($high, {n}), IdxMin($low, {n})), {n}.0)",
    "CNTD": "Sub(Mean(Gt($close, Ref($close, 1)), {n}), Mean(Lt($close, Ref($close, 1)), {n}))",
    "SUMD": "Div(Sub(Sum(Greater(Sub($close, Ref($close, 1)), 0.0), {n}), Sum(Greater(Sub(Ref($close, 1), $close), 0.0), {n})), Add(Sum(Abs(Sub($close, Ref($close, 1))), {n}), 1e-12))",
    "WVMA": "Div(Std(Mul(Abs(Sub(Div($close, Ref($close, 1)), 1.0)), $volume), {n}), Add(Mean(Mul(Abs(Sub(Div($close, Ref($close, 1)), 1.0)), $volume), {n}), 1e-12))",
    "VSUMD": "Div(Sub(Sum(Greater(Sub($volume, Ref($volume, 1)), 0.0), {n}), Sum(Greater(Sub(Ref($volume, 1), $volume), 0.0), {n})), Add(Sum(Abs(Sub($volume, Ref($volume, 1))), {n}), 1e-12))",
}


def handler(extra: dict[str, str] | None = None, ref: int = -2, windows: tuple[int, ...] = WINDOWS) -> dict[str, str]:
    """The features of the published set (less VWAP0, for which a panel needs an average price), ``extra`` ones, and the label over ``ref``."""
    base = {k: v for k, v in COMPOSITES.items() if k.startswith("K")} | PRICES
    base |= {f"{k}{n}": e.format(n=n) for k, e in (FAMILIES | MORE_FAMILIES).items() for n in windows}
    return base | (extra or {}) | {"LABEL0": f"Div(Ref($close, {ref}), Ref($close, -1)) - 1"}


def genes(windows: tuple[int, ...] = WINDOWS) -> dict[str, str]:
    """Every composite and every family at every window."""
    return COMPOSITES | {f"{k}{n}": e.format(n=n) for k, e in FAMILIES.items() for n in windows}
