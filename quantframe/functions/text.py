"""Text columns: cleaning, masking, keys, chunks, tokens and scores."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0            "
    "    　"
)

# Masking patterns, applied in this order.
PII_PATTERNS = {
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,16}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b",
    "PHONE_NUMBER": r"\b(?:\+?(\d{1,3}))?[-. (]*(\d{3})[-. )]*(\d{3})[-. ]*(\d{4})(?: *x(\d+))?\b",
    "DNI": r"\b\d{1,2}\.?\d{3}\.?\d{3}\b",
}

# Words that make a request transactional.
TRANSACTIONAL_KEYWORDS = [
    "alert", "create", "delete", "notify", "my", "have", "account", "buy", "sell", "trade", "portfolio", "position",
]

# Search terms of each followed asset.
TICKER_QUERIES = {
    "AAPL": "Apple OR AAPL",
    "MSFT": "Microsoft OR MSFT",
    "GOOGL": "Google OR Alphabet OR GOOGL",
    "AMZN": "Amazon OR AMZN",
    "NVDA": "Nvidia OR NVDA",
    "META": "Meta OR Facebook OR META",
    "TSLA": "Tesla OR TSLA",
    "Bitcoin": "Bitcoin OR BTC",
    "Ethereum": "Ethereum OR ETH",
    "SPY": "S&P 500 OR SPY",
    "QQQ": "Nasdaq OR QQQ",
    "DIA": "Dow Jones OR DIA",
    "IWM": "Russell 2000 OR IWM",
    "GLD": "Gold OR GLD",
    "TLT": "Treasury Bonds OR TLT",
}

TITLE_CHARS = 40
CHUNK_CHARS, CHUNK_OVERLAP = 500, 50
SEPARATORS = ("\n\n", "\n", ".", " ", "")
REMOVED = "[Removed]"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def mask_pii(text: Column) -> Column:
    for kind, pattern in PII_PATTERNS.items():
        text = F.regexp_replace(text, F.lit(pattern), F.lit(f"[{kind}_REDACTED]"))
    return text


def has_pii(text: Column) -> Column:
    return F.coalesce(mask_pii(text) != text, F.lit(False))


def is_transactional(text: Column) -> Column:
    lowered = F.lower(text)
    return F.exists(F.array(*[F.lit(w) for w in TRANSACTIONAL_KEYWORDS]), lambda w: F.contains(lowered, w))


def conv_title(message: Column) -> Column:
    return F.concat(F.substring(message, 1, TITLE_CHARS), F.lit("..."))


def epoch(iso: Column) -> Column:
    """ISO-8601 instant to epoch seconds."""
    return F.unix_micros(F.to_timestamp(iso)) / F.lit(1e6)


def epoch_ntz(seconds: Column) -> Column:
    """Epoch seconds as a zone-less UTC timestamp, whatever the session's zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def float_text(value: Column) -> Column:
    """A double as Python prints it, for whole values (``1720447200.0``) and short fractions."""
    whole = value == F.floor(value)
    decimals = F.rtrim(F.format_string("%.6f", value), F.lit("0"))
    return F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(decimals)


def vector_id(chunk: Column, position: Column, published_at: Column) -> Column:
    return F.md5(F.concat_ws("_", chunk, position.cast("string"), float_text(published_at)))


def all_tokens(text: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Distinct lower-cased word tokens."""
    return F.array_distinct(all_tokens(text))


def pair_score(query: Column, text: Column) -> Column:
    """Share of the query's tokens that occur in the text."""
    wanted = tokens(query)
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(wanted, tokens(text))).cast("double"), F.size(wanted).cast("double")),
        F.lit(0.0),
    )


def fixed_chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Consecutive pieces of ``size`` characters, each repeating the last ``overlap`` of the one before."""
    step = size - overlap
    extra = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), extra), lambda i: i * F.lit(step) + F.lit(1))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))


def _pieces(text: str, separator: str) -> list[str]:
    """Split before each separator, so that the separator opens the next piece."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in (head, *(separator + t for t in tail)) if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join consecutive pieces up to ``size``, starting the next join with up to ``overlap`` of the last."""
    first, length = 0, 0
    for i, piece in enumerate(pieces):
        if length + len(piece) > size and first < i:
            yield "".join(pieces[first:i])
            while length > overlap or (length and length + len(piece) > size):
                length -= len(pieces[first])
                first += 1
        length += len(piece)
    yield "".join(pieces[first:])


def split_recursively(
    text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS
) -> list[str]:
    """Chunks of at most ``size`` characters cut at the coarsest separator that works."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    small: list[str] = []

    def flush() -> None:
        if small:
            out.extend(c for c in (packed.strip() for packed in _pack(small, size, overlap)) if c)
            small.clear()

    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        flush()
        out.extend(split_recursively(piece, size, overlap, finer) if finer else [piece])
    flush()
    return out


_PACKED = "struct<out:array<struct<text:string,done:boolean>>,held:array<string>,length:int>"


def _packed(segment: Column, separator: str, size: int, overlap: int) -> Column:
    """Cut a segment at a separator and join consecutive short pieces; pieces of ``size`` and more are left to cut."""
    parts = F.transform(
        F.split(segment, F.lit(rf"\Q{separator}\E"), F.lit(-1)), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(separator), x))
    )
    pieces = F.filter(parts, lambda x: x != "")
    entry = lambda text, done: F.array(F.struct(text.alias("text"), F.lit(done).alias("done")))

    def flushed(state: Column) -> Column:
        return F.when(F.size(state["held"]) > 0, F.concat(state["out"], entry(F.array_join(state["held"], ""), True))).otherwise(state["out"])

    def step(state: Column, piece: Column) -> Column:
        n, held, length = F.length(piece), state["held"], state["length"]
        full = (length + n > size) & (F.size(held) > 0)
        # what the next chunk repeats: the held pieces but for so many in front that the rest is short enough
        drop = F.struct(length.alias("rest"), F.lit(0).alias("drop"))
        too_long = lambda d: (d["rest"] > overlap) | ((d["rest"] > 0) & (d["rest"] + n > size))
        shorter = lambda d, x: F.when(too_long(d), F.struct((d["rest"] - F.length(x)).alias("rest"), (d["drop"] + 1).alias("drop"))).otherwise(d)
        kept = F.aggregate(held, drop, shorter)
        repeated = F.slice(held, kept["drop"] + 1, F.size(held))
        state_of = lambda out, pieces, n: F.struct(out.alias("out"), pieces.alias("held"), n.cast("int").alias("length"))
        none = F.array().cast("array<string>")
        return (
            F.when(n >= size, state_of(F.concat(flushed(state), entry(piece, False)), none, F.lit(0)))
            .when(full, state_of(flushed(state), F.concat(repeated, F.array(piece)), kept["rest"] + n))
            .otherwise(state_of(state["out"], F.concat(held, F.array(piece)), length + n))
        )

    empty = F.struct(F.array().cast("array<struct<text:string,done:boolean>>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("length"))
    return F.aggregate(pieces, empty.cast(_PACKED), step, flushed)


def recursive_chunks(
    text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS
) -> Column:
    """``split_recursively`` in built-in functions: one pass over the segments per separator.

    A segment is a chunk (done) or too long.  At each separator the long ones that hold it are cut and packed; the last
    separator is the empty one, whose pieces are characters, so windows of equal size remain.
    """
    def cut(separator: str):
        def level(s: Column) -> Column:
            if separator:
                parts, long = _packed(s["text"], separator, size, overlap), ~s["done"] & F.contains(s["text"], F.lit(separator))
            else:
                windows = fixed_chunks(s["text"], size, overlap)
                parts, long = F.transform(windows, lambda x: F.struct(x.alias("text"), F.lit(True).alias("done"))), ~s["done"]
            return F.when(long, parts).otherwise(F.array(s))

        return level

    segments = F.array(F.struct(text.alias("text"), (F.length(text) < size).alias("done")))
    for separator in separators:
        segments = F.flatten(F.transform(segments, cut(separator)))
    chunks = F.filter(F.transform(segments, lambda s: strip(s["text"])), lambda t: t != "")
    return F.coalesce(chunks, F.array().cast("array<string>"))
