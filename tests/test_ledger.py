"""Table-driven damage cases: every ledger is one case."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from earshot.functions import hashing as H
from earshot.operators import blocks as B
from earshot.operators import ledger as L
from earshot.sources import stores

T0 = 1_700_000_000_123_450
CASES = {
    "clean": (True, 4, "CHAIN_INTEGRITY_OK"),
    "data": (False, 2, "CHAIN_TAMPER_DETECTED"),
    "own_hash": (False, 1, "CHAIN_TAMPER_DETECTED"),
    "link": (False, 2, "BROKEN_CHAIN_LINK"),
    "deleted": (False, 2, "SEQUENCE_BROKEN"),
    "duplicated": (False, 2, "SEQUENCE_BROKEN"),
    "reordered": (False, 1, "SEQUENCE_BROKEN"),
    "index": (False, 3, "SEQUENCE_BROKEN"),
    "clock": (False, 2, "TIMESTAMP_OUT_OF_ORDER"),
    "small_skew": (True, 4, "CHAIN_INTEGRITY_OK"),
    "no_time": (False, 1, "INVALID_BLOCK_SCHEMA"),
    "no_type": (False, 1, "INVALID_BLOCK_SCHEMA"),
    "not_object": (False, 1, "INVALID_BLOCK_SCHEMA"),
    "genesis_type": (False, 0, "GENESIS_BLOCK_INVALID"),
    "genesis_link": (False, 0, "GENESIS_BLOCK_INVALID"),
    "empty": (False, 0, "EMPTY_LEDGER"),
}


def digest(index, ts, kind, data, prev):
    body = {"index": index, "timestamp": ts, "event_type": kind, "event_data": data, "previous_hash": prev}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def seal(rows):
    """Hash rows in order with the standard library, the way another writer would."""
    prev, out = "0" * 64, []
    for r in rows:
        r = dict(r, previous_hash=prev)
        r["current_hash"] = prev = digest(r["index"], r["ts_us"] / 1e6, r["event_type"], json.loads(r["payload"]), prev)
        out.append(r)
    return out


def base(skew=0):
    rows = [dict(pos=0, index=0, ts_us=T0, event_type="GENESIS", payload=L.GENESIS_PAYLOAD)]
    rows += [dict(pos=i, index=i, ts_us=T0 + i * 1_000_000 - (skew if i == 2 else 0), event_type="ALERT", payload=json.dumps({"n": i}, separators=(",", ":"))) for i in (1, 2, 3)]
    return seal(rows)


def damaged(name):
    b = base({"clock": 5_000_000, "small_skew": 1_900_000}.get(name, 0))
    if name == "data":
        b[2]["payload"] = '{"n":9}'
    elif name == "own_hash":
        b[1]["current_hash"] = "e" * 64
    elif name == "link":
        b[2]["previous_hash"] = "f" * 64
    elif name == "deleted":
        del b[2]
    elif name == "duplicated":
        b.insert(2, dict(b[1]))
    elif name == "reordered":
        b[1], b[2] = b[2], b[1]
    elif name == "index":
        b[3]["index"] = 7
    elif name == "no_time":
        b[1]["ts_us"] = 0
    elif name == "no_type":
        b[1]["event_type"] = ""
    elif name == "not_object":
        b[1]["payload"] = "[1]"
    elif name == "genesis_type":
        b[0]["event_type"] = "START"
    elif name == "genesis_link":
        b[0]["previous_hash"] = "1" * 64
    elif name == "empty":
        return []
    return [dict(r, pos=i) for i, r in enumerate(b)]


SCHEMA = "ledger_id string, pos long, index long, ts_us long, event_type string, payload string, previous_hash string, current_hash string"


@pytest.fixture(scope="module")
def ledgers(spark):
    rows = [tuple({"ledger_id": n, **r}[c] for c in L.BLOCK_COLUMNS) for n in CASES for r in damaged(n)]
    return spark.createDataFrame(rows, SCHEMA).cache(), spark.createDataFrame([(n,) for n in CASES], "ledger_id string")


def test_damage_cases(ledgers):
    got = {r.ledger_id: (r.valid, r.blocks_verified, r.status) for r in L.verify(*ledgers).collect()}
    assert got == CASES


def test_small_blocks_give_the_same_verdict(ledgers):
    big, small = L.check_blocks(ledgers[0]), L.check_blocks(ledgers[0], block_rows=1)
    cols = ["ledger_id", "position", "status"]
    assert big.select(cols).exceptAll(small.select(cols)).count() == 0


def test_append_equals_other_writers(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "ledger_id string")
    first = L.genesis(ids, F.lit(T0))
    events = ids.select("ledger_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("id")).select("ledger_id", (F.lit(T0) + F.col("id") * 1_500_000).alias("ts_us"), F.lit("ALERT").alias("event_type"), H.event_payload(n="id").alias("payload"))
    new = L.append_events(first, events, ["ts_us"], F.floor(F.col("ts_us") / 2e6))
    chain = first.select(*L.BLOCK_COLUMNS).unionByName(new)
    assert all(r.valid and r.blocks_verified == 6 for r in L.verify(chain).collect())
    want = seal([dict(pos=0, index=0, ts_us=T0, event_type="GENESIS", payload=L.GENESIS_PAYLOAD)]
                + [dict(pos=i, index=i, ts_us=T0 + i * 1_500_000, event_type="ALERT", payload=json.dumps({"n": i}, separators=(",", ":"))) for i in range(1, 6)])
    for name in ("a", "b"):
        got = chain.filter(F.col("ledger_id") == name).orderBy("pos").collect()
        assert [r.current_hash for r in got] == [w["current_hash"] for w in want]
    digests = {r.ledger_id: r for r in L.cumulative_digests(chain).collect()}
    assert digests["a"].cumulative_hash == hashlib.sha256("".join(w["current_hash"] for w in want).encode()).hexdigest() and digests["a"].blocks_count == 6


def test_checkpoints(ledgers, spark):
    df, _ = ledgers
    cp = L.create_checkpoints(df)
    assert {r.ledger_id for r in cp.collect()} == {"clean", "small_skew"}
    forged = cp.withColumn("cumulative_hash", F.when(F.col("ledger_id") == "clean", "x").otherwise(F.col("cumulative_hash")))
    got = {r.ledger_id: r.status for r in L.verify_against_checkpoints(df, forged).collect()}
    assert got == {"clean": "CHECKPOINT_CUMULATIVE_MISMATCH", "small_skew": "CHECKPOINT_VERIFIED_OK"}
    # a chain rewritten from scratch is consistent in itself but not with the checkpoint
    fake = seal([dict(r, payload='{"n":0}') if r["pos"] == 1 else r for r in base()])
    fake = spark.createDataFrame([tuple({"ledger_id": "clean", **r}[c] for c in L.BLOCK_COLUMNS) for r in fake], SCHEMA)
    row = L.verify_against_checkpoints(fake, cp.filter("ledger_id = 'clean'")).first()
    assert row.status == "CHECKPOINT_MISMATCH" and row.blocks_verified == 3
    longer = L.append_events(L.heads(df.filter("ledger_id = 'clean'")), spark.createDataFrame([("clean", T0 + 9_000_000, "ALERT", '{"n":4}')], "ledger_id string, ts_us long, event_type string, payload string"), ["ts_us"], F.lit(0))
    grown = df.filter("ledger_id = 'clean'").select(*L.BLOCK_COLUMNS).unionByName(longer)
    assert L.verify_against_checkpoints(grown, cp.filter("ledger_id = 'clean'")).first().status == "CHECKPOINT_VERIFIED_OK"


def test_refuse_and_recover(ledgers, spark, tmp_path):
    df, names = ledgers
    ok, refused = L.appendable(df, names)
    assert {r.ledger_id for r in ok.collect()} == {"clean", "small_skew"} and refused.count() == len(CASES) - 2
    usable, broken = L.recover(df, str(tmp_path / "q"), F.lit(T0), force_new_genesis=False)
    assert {r.ledger_id for r in usable.select("ledger_id").distinct().collect()} == {"clean", "small_skew"}
    kept = spark.read.parquet(str(tmp_path / "q"))
    assert kept.count() == df.count() - 8 and broken.filter("recovered").count() == 0
    fresh, _ = L.recover(df, str(tmp_path / "q2"), F.lit(T0), force_new_genesis=True)
    assert all(r.valid for r in L.verify(fresh).collect())


def test_foreign_hash_forms(spark):
    body = {"index": 1, "timestamp": 1700000000.1234567, "event_type": "E", "event_data": {"b": 1.5, "a": "é"}, "previous_hash": "p"}
    compact = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    spaced = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    rows = [(1, 1700000000.1234567, "E", '{"b": 1.5, "a": "é"}', "p", h) for h in (compact, spaced, "0" * 64)] + [(1, 1.0, "E", "not json", "p", compact)]
    df = spark.createDataFrame(rows, "index long, ts double, event_type string, payload string, previous_hash string, current_hash string")
    got = [r[0] for r in df.select(H.foreign_hash_ok("index", "ts", "event_type", "payload", "previous_hash", "current_hash")).collect()]
    assert got == [True, True, False, False]


def test_ledger_files(spark, tmp_path):
    blocks = [{"index": r["index"], "timestamp": r["ts_us"] / 1e6, "event_type": r["event_type"], "event_data": json.loads(r["payload"]), "previous_hash": r["previous_hash"], "current_hash": r["current_hash"]} for r in base()]
    for name, text in {"good": json.dumps(blocks, indent=2), "bad": "[{", "empty": "", "object": "{}", "none": "[]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    expected = spark.createDataFrame([(f"file:{tmp_path}/{n}.json",) for n in ("good", "bad", "empty", "object", "none")], "ledger_id string")
    got, status = stores.read_ledger_files(spark, str(tmp_path), expected)
    by = {r.ledger_id.rsplit("/", 1)[1]: r.status for r in status.collect()}
    assert by == {"good.json": "LOADED", "bad.json": "INVALID_JSON", "empty.json": "EMPTY_FILE", "object.json": "NOT_A_LIST", "none.json": "EMPTY_LEDGER"}
    ok = H.foreign_hash_ok("index", "timestamp", "event_type", "payload", "previous_hash", "current_hash")
    row = L.verify(got, foreign_ok=ok).first()
    assert row.valid and row.blocks_verified == 4
    few, status = stores.read_ledger_files(spark, str(tmp_path), expected, largest=100)
    assert few.count() == 0 and {r.ledger_id.rsplit("/", 1)[1]: r.status for r in status.collect()} == {**by, "good.json": "TOO_LARGE"}


def test_row_blocks_are_bounded(spark):
    df = spark.range(10).select(F.lit("x").alias("k"), "id")
    assert [r.rn for r in B.row_index(df, ["k"], ["id"], B.int_block("id", 3)).orderBy("id").collect()] == list(range(1, 11))


def test_writer_refuses_ledgers_broken_between_batches(spark, tmp_path, monkeypatch):
    from earshot.streaming import jobs as J

    monkeypatch.setattr(J, "BASE_EVERY", 3)
    path = str(tmp_path / "ledger")
    write = J.ledger_writer(path, T0, ["ts_us"], lambda: T0 + 10)

    def batch(number, names):
        rows = [(n, T0 + number, "E", json.dumps({"b": number})) for n in names]
        write(spark.createDataFrame(rows, "ledger_id string, ts_us long, event_type string, payload string"), number)

    files = lambda n: spark.read.parquet(f"{path}/_heads/batch={n}")
    verdict = lambda: {r.ledger_id: (r.valid, r.blocks_verified) for r in L.verify(spark.read.parquet(path)).collect()}
    batch(0, "abcdef")
    batch(1, "ab")
    assert {r.ledger_id for r in files(1).collect()} == {"a", "b"}  # what is written follows the batch
    # someone rewrites a block of c: its next event is refused, those of others are not
    held = spark.read.parquet(f"{path}/batch=0").collect()
    changed = [r.asDict() | ({"payload": '{"b":9}'} if r.ledger_id == "c" and r.pos == 1 else {}) for r in held]
    spark.createDataFrame([tuple(r[c] for c in L.BLOCK_COLUMNS) for r in changed], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch=0")
    for number in range(2, 8):
        batch(number, "abc" if number % 2 else "ac")
    got = verdict()
    assert got["a"] == (True, 9) and got["b"] == (True, 6) and got["d"] == (True, 2) and not got["c"][0]
    refused = J.rejected_events(spark, path).collect()
    assert len(refused) == 6 and {(r.ledger_id, r.reason) for r in refused} == {("c", "LEDGER_BROKEN")}
    # heads come from the base and the batches after it
    assert {r.ledger_id: r["index"] for r in J.LedgerHeads(spark, path, "string").read(8).collect()} == {"a": 8, "b": 5, "c": 1, "d": 1, "e": 1, "f": 1}
    # a whole folder goes: ledgers that lost blocks take no more events
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=1")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    batch(8, "abd")
    assert {(r.ledger_id, r.ts_us) for r in J.rejected_events(spark, path).collect() if r.ts_us == T0 + 8} == {("a", T0 + 8), ("b", T0 + 8)}
    # a batch that is written again leaves the same ledger
    before = spark.read.parquet(path).count()
    batch(8, "abd")
    assert spark.read.parquet(path).count() == before
