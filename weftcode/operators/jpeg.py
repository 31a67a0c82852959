"""JPEG-style source coding.

All per-row work is expressions over arrays, inside one stage without an exchange. Symbol counts are one
aggregation; the Huffman trees, of at most a few hundred symbols, are built on the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import dct_2d, zigzag, zigzag_order
from .inference import linear_codes

#: Luminance bin widths for 8x8 blocks of data in [0, 255], by (v, h) frequency.
LUMINANCE = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61],
        [12, 12, 14, 19, 26, 58, 60, 55],
        [14, 13, 16, 24, 40, 57, 69, 56],
        [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77],
        [24, 35, 55, 64, 81, 104, 113, 92],
        [49, 64, 78, 87, 103, 121, 120, 101],
        [72, 92, 95, 98, 112, 100, 103, 99],
    ]
)
ZERO_RUN, END_OF_BLOCK, NO_DC = "f0", "00", "-"
#: A symbol has one hexadecimal digit for the number of bits.
MOST_BITS = 15


def bin_widths() -> np.ndarray:
    """Luminance widths in zigzag order."""
    return zigzag(LUMINANCE)


def zigzag_dct(height: int = 8, width: int = 8) -> np.ndarray:
    """2-D DCT rows in zigzag order of their frequencies."""
    return dct_2d(height, width)[[v * width + h for v, h in zigzag_order(height, width)]]


def analyze(df: DataFrame, height: int = 8, width: int = 8, col: str = "x", out: str = "code") -> DataFrame:
    return linear_codes(df, zigzag_dct(height, width), True, col, out)


def quantize(df: DataFrame, widths, col: str = "code", out: str = "q", digits: int = 9) -> DataFrame:
    """Nearest multiple of each component's width, halves up, as an index that is 0 for 0.

    Codes are rounded to so many digits first, so that engines that add in another order agree at bin edges.
    """
    w = F.array(*(F.lit(float(x)) for x in widths))
    return df.withColumn(out, F.zip_with(col, w, lambda c, b: F.floor(F.round(c, digits) / b + 0.5).cast("int")))


def dequantize(df: DataFrame, widths, col: str = "q", out: str = "code") -> DataFrame:
    w = F.array(*(F.lit(float(x)) for x in widths))
    return df.withColumn(out, F.zip_with(col, w, lambda q, b: q * b))


def bits(v):
    """Binary digits of a column of integers; a negative number has those of its absolute value, flipped; 0 has none."""
    digits = F.bin(F.abs(v))
    return F.when(v == 0, F.lit("")).when(v > 0, digits).otherwise(F.translate(digits, "01", "10"))


def coded_bits(v):
    """bits(v), if a symbol can tell their number."""
    long = F.concat(F.lit("no symbol for "), v.cast("string"))
    return F.when(F.abs(v) < 1 << MOST_BITS, bits(v)).when(v.isNotNull(), F.raise_error(long))


def digit(n):
    return F.lower(F.hex(n))


def run_lengths(df: DataFrame, col: str = "q") -> DataFrame:
    """Add ac (symbols to the last nonzero and the end mark), ac_bits (raw bits after each symbol), dc and dc_bits.

    A number of more than ``MOST_BITS`` bits has no symbol, which is an error.
    """
    last = F.size(col) - 1
    places = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: (i <= last) & (F.get(col, i) != 0))
    with_places = df.withColumn("__at", places)
    gap = lambda i, k: i - F.when(k > 0, F.get("__at", k - 1)).otherwise(F.lit(0)) - 1
    own = lambda i: coded_bits(F.get(col, i))
    symbol = lambda i, k: F.concat(digit(gap(i, k) % 16), digit(F.length(own(i))))
    long_runs = lambda i, k: F.array_repeat(F.lit(ZERO_RUN), F.floor(gap(i, k) / 16).cast("int"))
    no_bits = lambda i, k: F.array_repeat(F.lit(""), F.floor(gap(i, k) / 16).cast("int"))
    ac = F.flatten(F.transform("__at", lambda i, k: F.concat(long_runs(i, k), F.array(symbol(i, k)))))
    raw = F.flatten(F.transform("__at", lambda i, k: F.concat(no_bits(i, k), F.array(own(i)))))
    dc = coded_bits(F.get(col, F.lit(0)))
    return with_places.withColumns(
        {
            "ac": F.concat(ac, F.array(F.lit(END_OF_BLOCK))), "ac_bits": raw, "dc_bits": dc,
            "dc": F.when(F.length(dc) == 0, F.lit(NO_DC)).otherwise(digit(F.length(dc))),
        }
    ).drop("__at")


def symbol_counts(coded: DataFrame) -> DataFrame:
    """(kind, symbol, n) over all rows."""
    both = F.concat(F.transform("ac", lambda s: F.struct(F.lit("ac").alias("kind"), s.alias("symbol"))), F.array(F.struct(F.lit("dc").alias("kind"), F.col("dc").alias("symbol"))))
    return coded.select(F.explode(both).alias("s")).groupBy("s.kind", "s.symbol").agg(F.count(F.lit(1)).alias("n"))


def ac_alphabet() -> list[str]:
    """All symbols that a row may need: any run with sizes to 10, the zero run, the end mark."""
    return [f"{run:x}{size:x}" for run in range(16) for size in range(11)]


def dc_alphabet() -> list[str]:
    return [NO_DC] + [f"{size:x}" for size in range(1, MOST_BITS)]


def huffman_code(counts: dict[str, int]) -> dict[str, str]:
    """Prefix code; of equal weights the tree with the smaller first symbol is taken first.

    A single symbol gets the code 0.
    """
    if len(counts) == 1:
        return {next(iter(counts)): "0"}
    heap = [(n, s, None, None) for s, n in counts.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        low, high = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (low[0] + high[0], low[1], low, high))
    out, todo = {}, [(heap[0], "")]
    while todo:
        (_, symbol, low, high), code = todo.pop()
        if low is None:
            out[symbol] = code
        else:
            todo += [(low, code + "0"), (high, code + "1")]
    return out


def huffman_tables(coded: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """AC and DC codes from the rows' symbols; unseen symbols of the alphabets count once."""
    return tables_of({(r.kind, r.symbol): r.n for r in symbol_counts(coded).collect()})  # a few hundred rows at most


def tables_of(found: dict[tuple[str, str], int]) -> tuple[dict[str, str], dict[str, str]]:
    """The same from counts by (kind, symbol)."""
    tables = []
    for kind, alphabet in (("ac", ac_alphabet()), ("dc", dc_alphabet())):
        seen = {s: n for (k, s), n in found.items() if k == kind}
        tables.append(huffman_code({s: 1 for s in alphabet} | seen))
    return tables[0], tables[1]


def encode(coded: DataFrame, ac_table: dict[str, str], dc_table: dict[str, str], out: str = "bits") -> DataFrame:
    """Add the bit string: each AC code with its raw bits, the end mark's code, then DC code and bits.

    A symbol that its table has no code for is an error.
    """
    table = lambda t: F.create_map(*(F.lit(x) for kv in t.items() for x in kv))

    def code(t, symbol):
        return F.coalesce(F.element_at(table(t), symbol), F.raise_error(F.concat(F.lit("no code for symbol "), symbol)))

    body = F.zip_with(F.slice("ac", 1, F.size("ac") - 1), "ac_bits", lambda s, b: F.concat(code(ac_table, s), b))
    stream = F.concat(F.array_join(body, ""), F.lit(ac_table[END_OF_BLOCK]), code(dc_table, F.col("dc")), F.col("dc_bits"))
    return coded.withColumn(out, stream)


def decode(stream: str, ac_table: dict[str, str], dc_table: dict[str, str], length: int) -> list[int]:
    """Inverse of encode for one row."""
    at, out, place = 0, [0] * length, 1

    def symbol(table):
        nonlocal at
        back, end = {c: s for s, c in table.items()}, at + 1
        while stream[at:end] not in back:
            if end > len(stream):
                raise ValueError("the stream ends inside a code")
            end += 1
        found, at = back[stream[at:end]], end
        return found

    def number(size):
        nonlocal at
        raw, at = stream[at : at + size], at + size
        if not raw:
            return 0
        return int(raw, 2) if raw[0] == "1" else -int(raw.translate(str.maketrans("01", "10")), 2)

    while (s := symbol(ac_table)) != END_OF_BLOCK:
        if s == ZERO_RUN:
            place += 16
            continue
        place += int(s[0], 16)
        out[place] = number(int(s[1], 16))
        place += 1
    dc = symbol(dc_table)
    out[0] = 0 if dc == NO_DC else number(int(dc, 16))
    return out


def fixed_table(alphabet: list[str], width: int = 8) -> dict[str, str]:
    """Codes of equal length, in order: a table that needs no data."""
    return {s: format(i, f"0{width}b") for i, s in enumerate(alphabet)}


def rate_distortion(df: DataFrame, multipliers: list[float], widths=None, scale_range: float = 255.0, col: str = "x", digits: int = 6) -> DataFrame:
    """(multiplier, bits_per_component, mse, psnr) of the whole dataset, each with Huffman tables of its own.

    Two passes, whatever the number of multipliers: symbols, raw bits and errors are counted for all of them side by
    side; a code's total length follows from the symbols' counts and the lengths of their codes.
    """
    widths = [float(x) for x in (bin_widths() if widths is None else widths)]
    each = analyze(df, col=col).select("code", F.explode(F.array(*(F.lit(float(m)) for m in multipliers))).alias("multiplier"))
    w = F.array(*(F.lit(x) for x in widths))
    scaled = each.withColumn("q", F.zip_with("code", w, lambda c, b: F.floor(F.round(c, 9) / (b * F.col("multiplier")) + 0.5).cast("int")))
    coded = run_lengths(scaled)
    both = F.concat(F.transform("ac", lambda s: F.struct(F.lit("ac").alias("kind"), s.alias("symbol"))), F.array(F.struct(F.lit("dc").alias("kind"), F.col("dc").alias("symbol"))))
    counts: dict[float, dict] = {float(m): {} for m in multipliers}
    for r in coded.select("multiplier", F.explode(both).alias("s")).groupBy("multiplier", "s.kind", "s.symbol").count().collect():
        counts[r[0]][r[1], r[2]] = r[3]
    code_bits = []
    for m, found in counts.items():  # the transform is orthonormal: errors of codes are errors of pixels
        tables = dict(zip(("ac", "dc"), tables_of(found)))
        code_bits.append((m, sum(n * len(tables[k][s]) for (k, s), n in found.items())))
    back = F.zip_with("q", w, lambda q, b: q * b * F.col("multiplier"))
    error = F.aggregate(F.zip_with("code", back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    raw = F.length(F.array_join("ac_bits", "")) + F.length("dc_bits")
    sums = coded.groupBy("multiplier").agg(F.sum(raw).alias("raw"), F.sum(error).alias("error"), F.count(F.lit(1)).alias("n"))
    rows = sums.join(F.broadcast(df.sparkSession.createDataFrame(code_bits, "multiplier double, coded long")), "multiplier")
    size = F.col("n") * len(widths)
    mse = F.col("error") / size
    psnr = F.when(mse > 0, 10 * F.log10(F.lit(scale_range**2) / mse)).otherwise(F.lit(float("inf")))
    return rows.select(
        "multiplier", F.round((F.col("raw") + F.col("coded")) / size, digits).alias("bits_per_component"), F.round(mse, digits).alias("mse"), F.round(psnr, digits).alias("psnr")
    )
