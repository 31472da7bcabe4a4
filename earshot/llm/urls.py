"""URL rules in sorted digest arrays.

A rule is a host with a path; it fits the host and its subdomains where the url's path starts with the rule's. The
index keeps the XXH64 of ``host + path`` as a sorted array in segment files of the shared folder. Workers map these
into memory, probe the suffixes of a host that a rule can have, with all rule lengths, by vectorised binary search, and compare the stored
text of every hit, so equal digests of different rules cannot mislead.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import filesystem, frozen, write_file

SEGMENT_KEYS = 4_000_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path: the parts after the first ``://`` up to ``/ ? #`` and up to ``? #``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(url)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _segment_writer(folder: str):
    def run(group):
        import pandas as pd
        import xxhash

        segment = int(group["segment"].iloc[0])
        keys = [(h + p).encode() for h, p in zip(group["host"], group["path"])]
        texts = [json.dumps([h, p, v]).encode() for h, p, v in zip(group["host"], group["path"], group["verdict"])]
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype="<u8")
        order = sorted(range(len(keys)), key=lambda i: (digests[i], texts[i]))
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in order])]).astype("<i8")
        write_file(f"{folder}/{segment:05d}.keys", lambda s: s.write(digests[order].tobytes()))
        write_file(f"{folder}/{segment:05d}.offsets", lambda s: s.write(offsets.tobytes()))
        write_file(f"{folder}/{segment:05d}.texts", lambda s: s.write(b"".join(texts[i] for i in order)))
        lengths = sorted({len(p.encode()) for p in group["path"]})
        labels = max(h.count(".") for h in group["host"]) + 1
        return pd.DataFrame({"segment": [segment], "rules": [len(keys)], "lengths": [lengths], "labels": [labels]})

    return run


def build_index(rules: DataFrame, folder: str | None = None) -> str:
    """Write the index of ``rules`` (host, path, verdict: allow or block) and return its folder.

    Rules without host are left out, hosts are lower-cased, a null path is empty. Of equal rules with different
    verdicts ``block`` counts. Segments are cut by the digest's leading bits, one task each.
    """
    import xxhash

    spark = rules.sparkSession
    folder = folder or scratch(spark, "url-rules")
    host = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter(F.length("host") > 0)
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    bits = max(0, (rules.count() // SEGMENT_KEYS).bit_length())

    @F.pandas_udf("int")
    def segment(host, path):
        import pandas as pd

        return pd.Series([xxhash.xxh64_intdigest((h + p).encode()) >> (64 - bits) if bits else 0 for h, p in zip(host, path)], dtype="int32")

    rules = rules.withColumn("segment", segment("host", "path"))
    written = frozen(rules.groupBy("segment").applyInPandas(_segment_writer(folder), "segment int, rules long, lengths array<int>, labels int"), "url-segments")
    lengths = sorted(r[0] for r in written.select(F.explode("lengths")).distinct().collect())  # path lengths: a few hundred numbers at most
    labels = written.agg(F.max("labels")).first()[0] or 0
    write_file(f"{folder}/index.json", lambda s: s.write(json.dumps({"bits": bits, "lengths": lengths, "labels": labels}).encode()))
    return folder


class RuleIndex:
    """The reading side: one per worker task, files are mapped on first use."""

    def __init__(self, folder: str):
        self.folder, self.segments = folder, {}
        store, name = filesystem(folder)
        with store.open_input_stream(name + "/index.json") as stream:
            about = json.loads(stream.read())
        self.bits, self.lengths, self.labels = about["bits"], about["lengths"], about["labels"]

    def _map(self, name: str, kind: str) -> np.ndarray:
        from pyarrow import fs

        store, path = filesystem(f"{self.folder}/{name}")
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound or not info.size:
            return np.zeros(0, dtype=kind)
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(path, dtype=kind, mode="r")
        with store.open_input_file(path) as stream:  # a store without mapping: a segment is bounded in size
            return np.frombuffer(stream.read(), dtype=kind)

    def segment(self, number: int):
        if number not in self.segments:
            self.segments[number] = self._map(f"{number:05d}.keys", "<u8"), self._map(f"{number:05d}.offsets", "<i8"), self._map(f"{number:05d}.texts", "u1")
        return self.segments[number]

    def find(self, probes: list[tuple[str, str]]) -> list[str | None]:
        """Verdict of each (host, path) that is a rule, else None."""
        import xxhash

        digests = np.array([xxhash.xxh64_intdigest((h + p).encode()) for h, p in probes], dtype=np.uint64)
        out: list[str | None] = [None] * len(probes)
        home = digests >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(digests), dtype=np.uint64)
        for number in np.unique(home).tolist():
            own = np.flatnonzero(home == number)
            keys, offsets, texts = self.segment(number)
            low, high = (np.searchsorted(keys, digests[own], side=side) for side in ("left", "right"))
            for i, first, last in zip(own[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                for at in range(first, last):
                    host, path, verdict = json.loads(texts[offsets[at] : offsets[at + 1]].tobytes())
                    if (host, path) == probes[i]:
                        out[i] = verdict
        return out


def _prefix(path: bytes, length: int) -> str | None:
    try:
        return path[:length].decode()
    except UnicodeDecodeError:  # cuts a character, so it is no rule
        return None


def judge_urls(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, ``rule`` (the longest rule that fits, or null) and ``verdict`` (its own, or ``otherwise``).

    A null url, or one without ``://``, has an empty host and path, which no rule fits. Of two fitting rules of equal
    length the one with the longer host counts. Repeated rows are judged alike; an empty table gives no rows; extra
    columns are not read.
    """

    def run(batches):
        import pyarrow as pa

        index = RuleIndex(folder)
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            asked: dict[tuple[str, str], int] = {}
            wanted: list[list[int]] = []
            known: dict[tuple[str, str], list[int]] = {}
            for host, path in zip(hosts, paths):
                raw = path.encode()
                starts = [p for n in index.lengths if n <= len(raw) and (p := _prefix(raw, n)) is not None]
                rows = []
                # no rule has more labels than the index says, so no longer suffix is built, however long the host is
                labels = host.rsplit(".", index.labels) if host else []
                labels = labels[-index.labels :] if index.labels else []
                for start in starts:
                    key = (host, start)
                    if key not in known:
                        known[key] = [asked.setdefault((".".join(labels[k:]), start), len(asked)) for k in range(len(labels))]
                    rows += known[key]
                wanted.append(rows)
            probes = list(asked)
            found = index.find(probes)
            rules, verdicts = [], []
            for rows in wanted:
                hit = max((r for r in rows if found[r] is not None), key=lambda r: (len(probes[r][0]) + len(probes[r][1]), len(probes[r][0])), default=None)
                rules.append(None if hit is None else "".join(probes[hit]))
                verdicts.append(otherwise if hit is None else found[hit])
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = split_url(F.col(f"`{url}`"))
    parts = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules (host, path, verdict) as a table; long lists are read from files."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
