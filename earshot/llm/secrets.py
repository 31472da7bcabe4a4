"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Runs of 20 or more letters and digits are candidates, wherever they stand: also between the slashes of a path or the dashes
of a name. So are longer runs that such marks join, where they pass for base64 as a whole; then their parts are not tried.
The encoding is inferred from the characters; in it, a chi-squared test of uniform use of the alphabet, a runs test and a test of serial correlation are
combined by Fisher's method into ``u``. Random strings have a uniform u, ordinary ones pile up near 0. For every
encoding and class of length, the share above one half tells how many random strings there are (Storey's estimate),
and the cut is the smallest u at which the expected share of ordinary strings among those found is within the limit.
Where few strings are above one half, chance is allowed for, so that sparse strata do not lose their random strings.
"""

from __future__ import annotations

import bisect
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# '=' only pads the end (base32 takes up to six), so a key glued to its name by one stands alone
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,6}")
PART = re.compile(r"[A-Za-z0-9]{20,}(?:={1,6}$)?")
JOINED = (re.compile(r"[A-Za-z0-9+/]{20,}(?:={1,6}$)?"), re.compile(r"[A-Za-z0-9_-]{20,}(?:={1,6}$)?"))
PASSES = 0.05  # u from which a joined run is taken as a whole

# alphabets in the order in which an encoding is looked for
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    # without any digit, or of digits alone
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("LETTERS", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("Letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("digits", "0123456789"),
)
_MIXED = 8  # encodings before those of one class
_PLACES = [{c: i for i, c in enumerate(alphabet)} for _, alphabet in ENCODINGS]
LENGTHS = (20, 24, 32, 40, 48, 64, 128)
GRID = [k / 100 for k in range(1, 51)]
FEW = 100  # strings above one half from which their number alone estimates the random ones


# ---- the battery -------------------------------------------------------------------------------------------------------


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[int, float] | None:
    """(stratum, u) of a candidate; None if it fits no encoding. A string of one class is tested in the alphabet of that class."""
    body = token.rstrip("=")
    if len(body) < LENGTHS[0]:
        return None
    mixed = any(c.isdigit() for c in body) and any(c.isalpha() for c in body)
    code = next((k for k, places in enumerate(_PLACES) if (k < _MIXED) == mixed and all(c in places for c in body)), None)
    if code is None:
        return None
    places, n = _PLACES[code], len(body)
    size, values = len(places), [_PLACES[code][c] for c in body]
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    # uniform alphabet: mean and variance of the statistic are exact for any length
    squares = sum(c * c for c in counts.values()) * size / n - n
    uniform = _upper((squares - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    # runs above and below the middle of the alphabet
    high = [2 * v >= size for v in values]
    ups = sum(high)
    downs = n - ups
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    if ups and downs:
        mean = 1 + 2 * ups * downs / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        steady = 2 * _upper(max(0.0, abs(runs - mean) - 0.5) / spread)
    else:
        steady = 2.0 ** (1 - n)
    # correlation of neighbours
    mean = sum(values) / n
    total = sum((v - mean) ** 2 for v in values)
    r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / total if total else 1.0
    serial = 2 * _upper(abs(r + 1 / (n - 1)) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, min(1.0, steady), min(1.0, serial)))
    return code * len(LENGTHS) + bisect.bisect_right(LENGTHS, n) - 1, math.exp(-half) * (1 + half + half * half / 2)


def cut_of(histogram: list[int], limit: float = 0.05) -> float:
    """Smallest u of ``GRID`` with an expected share of ordinary strings within ``limit``; ``histogram``: counts per hundredth.

    With under ``FEW`` strings above one half, the estimate of random strings is noise: a cut rises only while the strings
    that it would keep exceed those expected by more than chance explains (one-sided, at 5 %). So a lone random string
    is not lost for having u < 0.5; in such a stratum a few ordinary strings may stay above the limit.
    """
    above = [0]
    for count in reversed(histogram):
        above.append(above[-1] + count)
    above.reverse()  # above[k]: u of k hundredths or more
    upper = above[50]
    for cut in GRID:
        found = above[round(100 * cut)]
        weight = 1 - 2 * cut  # strings between cut and one half for each above it, if all are random
        surplus = found - upper - weight * upper
        noise = 1.645 * math.sqrt(max(1, found - upper) + weight * weight * upper) if upper < FEW else 0.0
        if found and surplus <= limit * found + noise:
            return cut
    return GRID[-1]


# ---- scanning ----------------------------------------------------------------------------------------------------------


def strings_of(token: str) -> list[tuple[int, int, int, float]]:
    """(start, end, stratum, u) of the candidates in a run of key characters; they do not overlap."""
    whole: list[tuple[int, int, int, float]] = []
    for pattern, marks in zip(JOINED, ("+/", "-_")):
        for m in pattern.finditer(token):
            if any(c in m.group() for c in marks) and (score := battery(m.group())) is not None and score[1] >= PASSES:
                whole.append((m.start(), m.end(), *score))
    whole.sort(key=lambda w: (w[0] - w[1], w[0]))  # the longest first
    out: list[tuple[int, int, int, float]] = []
    for w in whole + [(m.start(), m.end(), *score) for m in PART.finditer(token) if (score := battery(m.group())) is not None]:
        if all(w[1] <= a or b <= w[0] for a, b, *_ in out):
            out.append(w)
    return sorted(out)


def scan(text: str) -> tuple[list[int], list[tuple[int, int, int]], list[tuple[int, int, int, int, float]]]:
    """Numbers of matches per pattern, their spans (start, kind, end) in order, and candidates (start, 3, end, stratum, u)."""
    base = []
    folded = text.lower()
    if any(w in folded for w in ASSIGN_WORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    base.sort()
    found, ends = [], []
    for start, _, end in base:  # furthest end of the spans up to here: they may overlap
        ends.append(max(end, ends[-1]) if ends else end)
    for match in CANDIDATE.finditer(text):
        for start, end, *score in strings_of(match.group()):
            start, end = start + match.start(), end + match.start()
            at = bisect.bisect_left(base, (end, -1, -1)) - 1
            if at < 0 or ends[at] <= start:  # otherwise a fixed pattern has it already
                found.append((start, 3, end, *score))
    return counts, base, found


_SCANNED = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base:array<struct<start:int,kind:int,end:int>>,found:array<struct<start:int,kind:int,end:int,stratum:int,u:double>>>"


def scan_column(text: Column) -> Column:
    """``scan`` of a text as a struct; a null text is empty."""

    @F.arrow_udf(_SCANNED)
    def run(texts):
        import pyarrow as pa

        span = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
        kind = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.list_(pa.struct(span))), ("found", pa.list_(pa.struct([*span, ("stratum", pa.int32()), ("u", pa.float64())])))])
        rows = []
        for text in texts:
            counts, base, found = scan(text.as_py() or "")
            rows.append({
                "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
                "base": [dict(zip(("start", "kind", "end"), b)) for b in base],
                "found": [dict(zip(("start", "kind", "end", "stratum", "u"), f)) for f in found],
            })
        return pa.array(rows, kind)

    return run(text)


def cuts(scanned: DataFrame, column: str = "scan", limit: float = 0.05) -> dict[int, float]:
    """Cut per stratum (encoding and class of length) from the candidates of all rows.

    The driver gets counts only: a hundred per stratum, of 84 strata at most.
    """
    hundredth = F.least(F.floor(F.col("c.u") * 100), F.lit(99)).cast("int")
    counted = scanned.select(F.explode(F.col(column).getField("found")).alias("c")).groupBy(F.col("c.stratum").alias("stratum"), hundredth.alias("bin")).count()
    histograms: dict[int, list[int]] = {}
    for stratum, at, count in counted.collect():
        histograms.setdefault(stratum, [0] * 100)[at] = count
    return {stratum: cut_of(h, limit) for stratum, h in histograms.items()}


def chosen_spans(scanned: Column, limits: dict[int, float]) -> Column:
    """All spans (start, kind, end) in order: those of the patterns, and candidates that reach their stratum's cut."""
    cut = F.lit(2.0)
    table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair]) if limits else None
    keep = F.filter(scanned.getField("found"), lambda c: c["u"] >= (table[c["stratum"]] if limits else cut))
    return F.array_sort(F.concat(scanned.getField("base"), F.transform(keep, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: float = 0.05) -> DataFrame:
    """A row per document: key, n_assign, n_access, n_hex, ``base`` and ``spans`` (start, kind, end; code points, kind an index of KINDS).

    Null and empty texts have no spans; every row of repeated rows is scanned alike; an empty table gives no rows;
    extra columns are not read. Candidates inside a pattern's span are not counted again.
    """
    scanned = frozen(docs.select(F.col(f"`{key}`").alias(key), scan_column(F.col(f"`{text}`")).alias("scan")), "secrets", "zstd")
    spans = chosen_spans(F.col("scan"), cuts(scanned, "scan", limit))
    return scanned.select(key, "scan.n_assign", "scan.n_access", "scan.n_hex", F.col("scan.base").alias("base"), spans.alias("spans"))


def redact(text: str, spans: list[dict], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    out, at, open_ = [], 0, False
    for span in spans:
        if span["start"] >= at or not open_:
            out += [text[at : span["start"]], mark]
            open_ = True
        at = max(at, span["end"])
    return "".join(out) + text[at:]


def redact_column(text: Column, spans: Column) -> Column:
    """``redact`` for texts that have spans; all others, and nulls, stay as they are."""

    @F.arrow_udf("string")
    def run(texts, found):
        import pyarrow as pa

        return pa.array([redact(t.as_py(), s.as_py()) if t.is_valid and s.is_valid and len(s) else t.as_py() for t, s in zip(texts, found)], pa.string())

    return run(text, spans)
