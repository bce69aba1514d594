"""Technical features of a daily panel.

All features come from one exchange by (ticker, block) and one sort: rolling frames read the
block's halo, exponentially weighted means read scaled running sums (see ``ewm``).  Features are
grouped in layers: a layer's columns are one projection over earlier layers, and its frames (see ``sliding``) are
one pass over the sorted blocks, which reads the columns of its own layer as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.operators import ewm
from quantframe.operators.sliding import Step, slide
from quantframe.operators.timeline import date_bucket, halo_blocks, with_ordinal
from quantframe.session import split_wide, staged

RETURN_LAGS = (1, 3, 5, 10, 14, 20)
AVERAGES = (9, 20, 50, 200)
RSI_PERIODS = (9, 14, 21)
EPS = 1e-8

FEATURES = [
    *[f"ret_{n}d" for n in RETURN_LAGS],
    "rel_strength_14d", "beta_20d", "spy_corr_20d", "vol_20d_std", "vol_shock_z", "price_accel_1d",
    "vix_return", "vix_divergence",
    *[f"dist_sma_{n}" for n in AVERAGES], *[f"dist_ema_{n}" for n in AVERAGES],
    "cross_ema_9_20", "cross_sma_50_200", "bb_width", "bb_pct_b",
    *[f"rsi_{n}" for n in RSI_PERIODS],
    "macd_hist", "candle_body", "upper_shadow", "lower_shadow", "natr_14",
]

BLOCK = 32768
SEGMENT = 2048
SHORT_HALO = 256


Layers = dict[int, dict[str, Column | Step]]

# 0: frames of the bars; 1: of these and the row alone; 2, 3: of layer 1 and the row alone, and in 3 frames of returns;
# 4, 5: of these and the row alone
LAYERS = 6
# of the helping columns ready before the frames of returns, the one that is read after them
READ_LATER = {"_macd"}


def _lag(x: Layers, at: int, column: str, n: int) -> Column:
    """Value ``n`` rows before, registered with the frames of layer ``at``."""
    x[at][name := f"_lag{n}_{column}"] = Step("lag", column, n)
    return F.col(name)


def _full(value: Column, n: int, first: int = 1) -> Column:
    """Value once the frame holds ``n`` rows and the input is defined from row ``first`` on."""
    return F.when(F.col("_rn") >= n + first - 1, value)


def _ewm_layers(layers: Layers, at: int, value: Column, name: str, span: float, adjust: bool) -> None:
    """Register the mean ``name`` of ``value``: summed up over segments or blocks in layer ``at``, ready in ``at + 1``."""
    rn, b = F.col("_rn"), F.lit(ewm.decay(span))
    term = ewm.seed_weight(value, span, adjust, rn)
    whole = ewm.fits(span, BLOCK + ewm.reach(200))
    if not whole and (ewm.reach(span) > SEGMENT or not ewm.fits(span, SEGMENT)):
        raise ValueError(f"segment length {SEGMENT} does not suit span {span}")
    place = F.col("_p" if whole else "_q")
    layers[at][f"__t_{name}"] = term * F.pow(b, -place)
    layers[at][f"_n_{name}"] = Step("running", f"__t_{name}", by="" if whole else "_seg")
    total = F.col(f"_n_{name}") * F.pow(b, place)
    if not whole:
        layers[at][f"_e_{name}"] = Step("carried", f"_n_{name}", SEGMENT - 1, by="_q")
        ended = F.col(f"_e_{name}") * F.pow(b, F.lit(SEGMENT - 1))
        total = total + F.coalesce(ended, F.lit(0.0)) * F.pow(b, place + 1)
    layers[at + 1][name] = ewm.finish(total, span, adjust, rn)


def _log_returns(x: Layers) -> None:
    for n in RETURN_LAGS:
        x[1][f"ret_{n}d"] = F.ln(F.try_divide(F.col("close"), _lag(x, 0, "close", n)))


def _relative_strength(x: Layers) -> None:
    x[2]["rel_strength_14d"] = F.col("ret_14d") - F.col("ret_spy_14d")


_MOMENTS = {
    "_r": lambda: F.col("ret_1d"),
    "_m": lambda: F.col("ret_spy_1d"),
    "_rm": lambda: F.col("ret_1d") * F.col("ret_spy_1d"),
    "_rr": lambda: F.col("ret_1d") * F.col("ret_1d"),
    "_mm": lambda: F.col("ret_spy_1d") * F.col("ret_spy_1d"),
    "_abs": lambda: F.abs(F.col("ret_1d")),
}
_DAYS = 20


def _moments(x: Layers, names: Iterable[str]) -> None:
    """Twenty-row sums ``<name>20`` as two ten-row sums; ``_n<name>`` counts the non-null inputs.

    Returns centre on zero, so plain sums of squares keep their precision.
    """
    for name in names:
        x[3][f"__v{name}"] = _MOMENTS[name]()
        x[3][f"_{name}10"] = Step("sum", f"__v{name}", 10, zero=True)
        x[3][f"{name}20"] = Step("steps", f"_{name}10", _DAYS, by=10, zero=True)
        if name in ("_r", "_rm"):
            x[3][f"__n{name}10"] = Step("count", f"__v{name}", 10)
            x[3][f"_n{name}"] = Step("steps", f"__n{name}10", _DAYS, by=10, zero=True)


def _spread(square: str, value: str) -> Column:
    """Sum of squared deviations; rounding residue of a constant input counts as zero."""
    total = F.col(f"{square}20")
    rest = total - F.col(f"{value}20") * F.col(f"{value}20") / _DAYS
    return F.when(rest > total * 1e-13, rest).otherwise(F.lit(0.0))


def _cross() -> Column:
    return F.col("_rm20") - F.col("_r20") * F.col("_m20") / _DAYS


def _rolling_beta(x: Layers) -> None:
    _moments(x, ("_r", "_m", "_rm", "_mm"))
    variance = _spread("_mm", "_m") / (_DAYS - 1)
    x[4]["beta_20d"] = F.when(F.col("_n_rm") == _DAYS, F.try_divide(_cross() / (_DAYS - 1), variance + F.lit(EPS)))


def _rolling_corr(x: Layers) -> None:
    _moments(x, ("_r", "_m", "_rm", "_rr", "_mm"))
    scale = F.sqrt(_spread("_rr", "_r")) * F.sqrt(_spread("_mm", "_m"))
    x[4]["spy_corr_20d"] = F.when(F.col("_n_rm") == _DAYS, F.try_divide(_cross(), scale))


def _rolling_vol(x: Layers) -> None:
    _moments(x, ("_r", "_rr"))
    x[4]["vol_20d_std"] = F.when(F.col("_n_r") == _DAYS, F.sqrt(_spread("_rr", "_r") / (_DAYS - 1)))


def _vol_shock(x: Layers) -> None:
    _moments(x, ("_r", "_abs"))
    mean = F.when(F.col("_n_r") == _DAYS, F.col("_abs20") / _DAYS)
    x[5]["vol_shock_z"] = F.try_divide(F.abs(F.col("ret_1d")) - mean, F.col("vol_20d_std") + F.lit(EPS))


def _price_accel(x: Layers) -> None:
    x[4]["price_accel_1d"] = F.col("ret_1d") - _lag(x, 3, "ret_1d", 1)


def _vix_divergence(x: Layers) -> None:
    x[2]["vix_divergence"] = F.col("ret_1d") * F.col("vix_return")


def _sma_columns(x: Layers) -> None:
    """Simple means; a long sum adds up lagged shorter ones, so no frame is wider than ten rows."""
    x[0]["_s9"] = Step("mean", "close", 9)
    x[0]["__sum10"] = Step("sum", "close", 10)
    for n, short, rows in ((20, "__sum10", 10), (50, "__sum10", 10), (200, "_sum50", 50)):
        x[0][f"_sum{n}"] = Step("steps", short, n, by=rows)
        x[1][f"_s{n}"] = F.col(f"_sum{n}") / F.lit(float(n))


def _sma(n: int) -> Column:
    return _full(F.col(f"_s{n}"), n)


def _dist_sma(x: Layers) -> None:
    _sma_columns(x)
    for n in AVERAGES:
        x[2][f"dist_sma_{n}"] = F.try_divide(F.col("close") - _sma(n), _sma(n))


def _dist_ema(x: Layers) -> None:
    for n in AVERAGES:
        _ewm_layers(x, 0, F.col("close"), f"_ema{n}", n, adjust=False)
        x[2][f"dist_ema_{n}"] = F.try_divide(F.col("close") - F.col(f"_ema{n}"), F.col(f"_ema{n}"))


def _cross_ema(x: Layers) -> None:
    for n in (9, 20):
        _ewm_layers(x, 0, F.col("close"), f"_adj{n}", n, adjust=True)
    x[2]["cross_ema_9_20"] = F.try_divide(F.col("_adj9"), F.col("_adj20"))


def _cross_sma(x: Layers) -> None:
    _sma_columns(x)
    x[2]["cross_sma_50_200"] = F.try_divide(_sma(50), _sma(200))


def _bollinger(x: Layers) -> None:
    _sma_columns(x)
    x[0]["_sd20"] = Step("std", "close", 20)
    mid, dev = _sma(20), _full(F.col("_sd20"), 20) * F.lit(2)
    upper, lower = mid + dev, mid - dev
    x[2]["bb_width"] = F.try_divide(upper - lower, mid)
    x[2]["bb_pct_b"] = F.try_divide(F.col("close") - lower, upper - lower + F.lit(EPS))


def _rsi(x: Layers) -> None:
    delta = F.coalesce(F.col("close") - _lag(x, 0, "close", 1), F.lit(0.0))
    x[1]["_gain"] = F.greatest(delta, F.lit(0.0))
    x[1]["_loss"] = F.greatest(-delta, F.lit(0.0))
    for side in ("_gain", "_loss"):
        x[3][f"_{side}7"] = Step("sum", side, 7)
        x[3][f"{side}9"] = Step("sum", side, 9)
        for n in (14, 21):
            x[3][f"{side}{n}"] = Step("steps", f"_{side}7", n, by=7)
    for n in RSI_PERIODS:
        strength = F.col(f"_gain{n}") / n / (F.col(f"_loss{n}") / n + F.lit(EPS))
        x[4][f"rsi_{n}"] = _full(F.lit(100) - F.lit(100) / (F.lit(1) + strength), n)


def _macd(x: Layers) -> None:
    for n in (12, 26):
        _ewm_layers(x, 0, F.col("close"), f"_ema{n}", n, adjust=False)
    x[2]["_macd"] = F.col("_ema12") - F.col("_ema26")
    _ewm_layers(x, 3, F.col("_macd"), "_signal", 9, adjust=False)
    x[5]["macd_hist"] = F.col("_macd") - F.col("_signal")


def _candles(x: Layers) -> None:
    spread = F.col("high") - F.col("low") + F.lit(EPS)
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    x[2]["candle_body"] = F.try_divide(F.abs(F.col("open") - F.col("close")), spread)
    x[2]["upper_shadow"] = F.try_divide(F.col("high") - top, spread)
    x[2]["lower_shadow"] = F.try_divide(bottom - F.col("low"), spread)


def _natr(x: Layers) -> None:
    before = _lag(x, 0, "close", 1)
    x[1]["_tr"] = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )
    x[3]["__tr7"] = Step("sum", "_tr", 7)
    x[3]["_tr14"] = Step("steps", "__tr7", 14, by=7)
    x[4]["natr_14"] = _full(F.try_divide(F.col("_tr14") / 14, F.col("close")), 14)


def _forward_return(x: Layers) -> None:
    x[1]["fwd_log_return"] = F.ln(F.try_divide(_lag(x, 0, "close", -1), F.col("close")))


Group = tuple[Callable[[Layers], None], tuple[str, ...], tuple[str, ...]]

# group -> (builder, output columns, groups it reads)
GROUPS: dict[str, Group] = {
    "log_returns": (_log_returns, tuple(f"ret_{n}d" for n in RETURN_LAGS), ()),
    "relative_strength": (_relative_strength, ("rel_strength_14d",), ("log_returns",)),
    "rolling_beta": (_rolling_beta, ("beta_20d",), ("log_returns",)),
    "rolling_corr": (_rolling_corr, ("spy_corr_20d",), ("log_returns",)),
    "rolling_vol": (_rolling_vol, ("vol_20d_std",), ("log_returns",)),
    "vol_shock": (_vol_shock, ("vol_shock_z",), ("log_returns", "rolling_vol")),
    "price_accel": (_price_accel, ("price_accel_1d",), ("log_returns",)),
    "vix_divergence": (_vix_divergence, ("vix_divergence",), ("log_returns",)),
    "dist_sma": (_dist_sma, tuple(f"dist_sma_{n}" for n in AVERAGES), ()),
    "dist_ema": (_dist_ema, tuple(f"dist_ema_{n}" for n in AVERAGES), ()),
    "cross_ema": (_cross_ema, ("cross_ema_9_20",), ()),
    "cross_sma": (_cross_sma, ("cross_sma_50_200",), ()),
    "bollinger": (_bollinger, ("bb_width", "bb_pct_b"), ()),
    "rsi": (_rsi, tuple(f"rsi_{n}" for n in RSI_PERIODS), ()),
    "macd": (_macd, ("macd_hist",), ()),
    "candles": (_candles, ("candle_body", "upper_shadow", "lower_shadow"), ()),
    "natr": (_natr, ("natr_14",), ()),
    "forward_return": (_forward_return, ("fwd_log_return",), ()),
}

_NEEDS_SPY = {"relative_strength", "rolling_beta", "rolling_corr"}
_NEEDS_VIX = {"vix_divergence"}
_LONG_MEMORY = {"dist_ema", "cross_ema", "macd"}


def number_bars(bars: DataFrame, ordinal: str = "bar_no") -> DataFrame:
    """Give each bar its 1-based position in its ticker, unless the frame already has it."""
    if ordinal in bars.columns:
        return bars
    return with_ordinal(bars, ["ticker"], ["date"], [date_bucket("date")], ordinal)


BROADCAST_ROWS = 500_000  # dates; two doubles and a date each, about 15 MB


def series_returns(bars: DataFrame, symbol: str, lags: dict[str, int]) -> DataFrame:
    """Log returns of one symbol by date, the first row per date."""
    columns = ["ticker", "date", "close", *(["bar_no"] if "bar_no" in bars.columns else [])]
    one = number_bars(bars.filter(F.col("ticker") == symbol).select(*columns))
    blocks = halo_blocks(one, ["ticker"], "bar_no", block=8192, halo=max(lags.values()), lead=False)
    window = Window.partitionBy("ticker", "_blk").orderBy("bar_no")
    shifted = {name: F.ln(F.try_divide(F.col("close"), F.lag("close", n).over(window))) for name, n in lags.items()}
    own = blocks.withColumns(shifted).filter("_own")
    first = own.groupBy("date").agg(F.min_by(F.struct(*lags), "bar_no").alias("_r"))
    return first.select("date", "_r.*")


def _join_by_date(panel: DataFrame, bars: DataFrame, symbol: str, lags: dict[str, int]) -> DataFrame:
    """Left join of a symbol's returns: broadcast when its history is checked to be short, else by shuffle."""
    returns = series_returns(bars, symbol, lags)
    rows = bars.filter(F.col("ticker") == symbol).select(F.lit(1)).limit(BROADCAST_ROWS + 1).count()
    return panel.join(F.broadcast(returns) if rows <= BROADCAST_ROWS else returns, "date", "left")


def benchmark_join(bars: DataFrame, symbol: str = "SPY", source: DataFrame | None = None) -> DataFrame:
    """Left-join the benchmark's 1- and 14-row log returns by date."""
    lags = {"ret_spy_1d": 1, "ret_spy_14d": 14}
    return _join_by_date(bars, bars if source is None else source, symbol, lags)


def macro_join(bars: DataFrame, symbol: str = "VIX", source: DataFrame | None = None) -> DataFrame:
    """Left-join the volatility index's log return by date."""
    return _join_by_date(bars, bars if source is None else source, symbol, {"vix_return": 1})


def vix_momentum(bars: DataFrame, symbol: str = "VIX") -> DataFrame:
    return series_returns(bars, symbol, {"vix_return": 1})


def compute(bars: DataFrame, groups: Iterable[str], block: int = BLOCK, halo: int | None = None) -> DataFrame:
    """Add the columns of the given feature groups to a numbered panel."""
    wanted: list[str] = []

    def add(group: str) -> None:
        for need in GROUPS[group][2]:
            add(need)
        if group not in wanted:
            wanted.append(group)

    groups = list(groups)
    for group in groups:
        add(group)
    if halo is None:
        halo = ewm.reach(200) if _LONG_MEMORY & set(wanted) else SHORT_HALO
    layers: Layers = {i: {} for i in range(LAYERS)}
    for group in wanted:
        GROUPS[group][0](layers)

    blocks = halo_blocks(bars, ["ticker"], "bar_no", block, halo)
    frame = blocks.withColumns(
        {
            "_rn": F.col("bar_no"),
            "_q": F.pmod(F.col("_p"), F.lit(SEGMENT)),
            "_seg": F.floor(F.col("_p") / F.lit(SEGMENT)).cast("int"),
        }
    )
    frame = frame.sortWithinPartitions("ticker", "_blk", "_rn")
    outputs = [c for g in groups for c in GROUPS[g][1]]
    split_wide(bars.sparkSession)
    helping: list[str] = []
    for layer in layers.values():
        columns = {name: c for name, c in layer.items() if isinstance(c, Column)}
        steps = {name: s for name, s in layer.items() if isinstance(s, Step)}
        frame = frame.withColumns(columns) if columns else frame
        if steps:
            read = {c for s in steps.values() for c in (s.column, s.by)} | READ_LATER
            frame = slide(frame.drop(*[c for c in helping if c not in read]), ["ticker", "_blk"], steps)
        helping += [name for name in layer if name.startswith("_")]
    return frame.filter("_own").select(*[c for c in bars.columns if c not in outputs], *outputs)


def feature_frame(bars: DataFrame, groups: Iterable[str] | None = None, **options) -> DataFrame:
    """Features of all non-VIX tickers, benchmark and macro columns joined as the groups need."""
    groups = list(groups or GROUPS)
    bars = number_bars(bars)
    panel = bars.filter(F.col("ticker") != "VIX")
    if _NEEDS_SPY & set(groups):
        panel = benchmark_join(panel, source=bars)
    if _NEEDS_VIX & set(groups):
        panel = macro_join(panel, source=bars)
    return compute(panel, groups, **options)


def drop_incomplete(features: DataFrame, inference: bool = False) -> DataFrame:
    """Rows with every feature; the forward return may be missing for inference."""
    needed = [c for c in FEATURES if c in features.columns]
    if not inference and "fwd_log_return" in features.columns:
        needed = [*needed, "fwd_log_return"]
    return features.dropna(subset=needed)


def leak_safe(features: DataFrame) -> DataFrame:
    """Only the allow-listed features next to key, close and target."""
    keep = ["ticker", "date", "close", *FEATURES, "fwd_log_return"]
    return features.select(*[c for c in keep if c in features.columns])


def feature_panel(bars: DataFrame, inference: bool = False, **options) -> DataFrame:
    """The complete leak-safe panel: every group, incomplete rows dropped."""
    return leak_safe(drop_incomplete(feature_frame(bars, **options), inference))


def null_report(features: DataFrame, required: list[str]) -> DataFrame:
    """Rows with holes, naming the missing columns."""
    holes = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda name: name.isNotNull()
    )
    return (
        features.select("ticker", "date", holes.alias("_holes"))
        .filter(F.size("_holes") > 0)
        .select("ticker", "date", F.array_join("_holes", ",").alias("missing"))
    )


def null_guard(features: DataFrame, required: list[str]) -> DataFrame:
    """Pass the frame through, failing the job on the first row with a missing required feature."""
    holes = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda name: name.isNotNull()
    )
    message = F.concat(
        F.lit("Ticker "), F.col("ticker"), F.lit(" has missing values in features: "), F.array_join(holes, ", ")
    )
    checked = F.when(F.size(holes) > 0, F.raise_error(message).cast("string")).otherwise(F.col("ticker"))
    return features.withColumn("ticker", checked)


def latest_cross_section(features: DataFrame) -> DataFrame:
    """Rows at the latest date of the frame, which is read once and not stored: a task passes on those of its own latest date."""

    def latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest, held = None, []
        for batch in batches:
            dates = batch.column("date")
            own = pc.max(dates).as_py()
            if own is None or (newest is not None and own < newest):
                continue
            if own != newest:
                newest, held = own, []
            held.append(batch.filter(pc.equal(dates, own)))
        yield from held

    ends = staged(features.mapInArrow(latest, features.schema))
    return ends.join(ends.agg(F.max("date").alias("date")), "date")
