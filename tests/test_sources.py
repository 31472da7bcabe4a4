import json

import pytest
from pyspark.sql import functions as F

from earshot.functions import corpus as C
from earshot.operators import models as M
from earshot.plans import experiment
from earshot.sources import media, metadata, stores


def test_protocols(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "ASVspoof2019.LA.cm.train.txt").write_text("LA_1 LA_T_1 - - bonafide\nLA_2  LA_T_2\t- A07 spoof extra\nshort line\n")
    (tmp_path / "p" / "other.txt").write_text("a b c d e\n")
    got = {r.audio_id: (r.speaker_id, r.system_id, r.label, r.label_str) for r in metadata.read_protocol_2019(spark, str(tmp_path / "p")).collect()}
    assert got == {"LA_T_1": ("LA_1", "bonafide", 0, "genuine"), "LA_T_2": ("LA_2", "A07", 1, "spoof")}
    (tmp_path / "t.txt").write_text("S1 DF_E_1 low_mp3 src A08 SPOOF x\nS2 DF_E_2 nocodec src - Bonafide\nS3 DF_E_3 x y z\n")
    got = {r.audio_id: (r.system_id, r.label) for r in metadata.read_trials_2021(spark, str(tmp_path / "t.txt")).collect()}
    assert got == {"DF_E_1": ("asv2021_A08_low_mp3", 1), "DF_E_2": ("asv2021_-_nocodec", 0)}


def test_index_means_and_transcripts(spark, tmp_path):
    (tmp_path / "i.tsv").write_text('1\ta.wav\tsay "x\'\ttext\tF\tspk7\n2\tb.wav\tonly\tfour\n')
    assert [tuple(r) for r in metadata.read_clip_index(spark, str(tmp_path / "i.tsv")).collect()] == [("a.wav", "spk7")]
    (tmp_path / "m.csv").write_text("system_ID,mean\nA07,1.5\n")
    assert metadata.read_system_means(spark, str(tmp_path / "m.csv")).first()["mean"] == 1.5
    (tmp_path / "x.trans.txt").write_text("2094-142345-0000 IT IS A FINE OLD PLACE\n")
    row = metadata.read_transcripts(spark, str(tmp_path)).first()
    assert (row.utt_id, row.reader, row.chapter, row.text) == ("2094-142345-0000", "2094", "142345", "IT IS A FINE OLD PLACE")


PATHS = [
    ("/d/Additional_Genuine/SLR65/train/tam_01_5.wav", "additional_genuine", "tam_01", "indic_slr65_tamil", 0),
    ("/d/additional_genuine/fleurs/Hindi/dev/u1.wav", "additional_genuine", None, "indic_fleurs_hindi", 0),
    ("/d/additional_genuine/indic_tts/x.wav", "additional_genuine", None, "indic_fleurs_indian_lang", 0),
    ("/d/IndicTTS/malayalam/a_b.wav", "indic_tts", "indictts_malayalam_spk", "indictts_malayalam", 0),
    ("/d/indic_synth/FreeVC24/tamil/a_b_c_s9.wav", "indic_synth", "s9", "indicsynth_freevc24_tamil", 1),
    ("/d/indic_synth/freevc/tamil/x.wav", "indic_synth", "synth_freevc_tamil_spk", "indicsynth_freevc_tamil", 1),
    ("/d/la/LA_T_1.flac", "asvspoof2019", "LA_1", "A07", 1),
    ("/d/librispeech/LA_T_2.flac", "asvspoof2019", "LA_2", "bonafide", 0),
    ("/d/x/DF_E_1.flac", "asvspoof2021", "S1", "asv2021_A08_low", 1),
    ("/d/asvspoof2021/genuine_4.flac", "asvspoof2021_unlisted", "speaker_unknown", "asv2021_df", 0),
    ("/d/LibriSpeech/2094-1-2.flac", "librispeech", "libri_2094", "bonafide", 0),
    ("/d/PhonemeDF/u.wav", "chatterbox", "chatterbox_speaker", "chatterbox_tts", 1),
    ("/d/x/ASV2019_1-A09-77.wav", "asv2019_named", "ASV2019_1", "A09", 1),
    ("/d/x/a_nat_1.wav", "fallback", "speaker_unknown", "bonafide", 0),
    ("/d/x/senate.wav", "fallback", "speaker_unknown", "spoof", 1),
]


def test_classification_order(spark):
    proto = spark.createDataFrame([("LA_T_1", "LA_1", "A07", 1), ("LA_T_1", "LA_1", "A07", 1), ("LA_T_2", "LA_2", "bonafide", 0)], "audio_id string, speaker_id string, system_id string, label int")
    trials = spark.createDataFrame([("DF_E_1", "S1", "asv2021_A08_low", 1)], "audio_id string, speaker_id string, system_id string, label int")
    df = spark.createDataFrame([(p[0],) for p in PATHS], "path string")
    got = {r.path: r for r in C.classify_paths(df, protocol=proto, trials=trials).collect()}
    assert len(got) == len(PATHS)
    for path, corpus, speaker, system, label in PATHS:
        r = got[path]
        assert (r.corpus, r.system_id, r.label) == (corpus, system, label), path
        assert speaker is None or r.speaker_id == speaker, path
    assert got["/d/additional_genuine/fleurs/Hindi/dev/u1.wav"].speaker_id.startswith("fleurs_hindi_dev_spk")
    assert got["/d/x/ASV2019_1-A09-77.wav"].audio_id == "77"
    loose = {r.path: r for r in C.classify_paths(df, token_fallback=False).collect()}
    assert loose["/d/x/senate.wav"].label == 0


def test_feature_cache(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(4).withColumn("split", F.lit("train"))

    path = str(tmp_path / "f")
    assert stores.cached_features(spark, path, build).count() == 4 and stores.cached_features(spark, path, build).count() == 4
    assert len(calls) == 1
    stores.cached_features(spark, path, build, force=True)
    assert len(calls) == 2


def test_queue_skips_blank_lines(spark, tmp_path):
    line = json.dumps({"event_type": "E", "payload": {"a": 1}, "session_id": None, "queued_at": 1.5})
    (tmp_path / "q.jsonl").write_text(f"{line}\n\n   \n{line}\n")
    q = stores.read_queue(spark, str(tmp_path))
    assert q.count() == 2 and json.loads(q.first().payload) == {"a": 1}
    assert stores.queue_status(q, False).first().node_mode == "ONLINE"


def test_messages(spark):
    import base64

    rows = [(1, json.dumps({"audio_chunk": base64.b64encode(b"abcde").decode()})), (2, json.dumps({"action": "configure", "language": "hi", "is_financial_transaction": True})), (3, "not json"), (4, json.dumps({"audio_chunk": ""}))]
    audio, config = media.json_messages(spark.createDataFrame(rows, "id int, message string"))
    assert [(r.id, bytes(r.pcm)) for r in audio.collect()] == [(1, b"abcd")]
    assert [(r.id, r.language, r.is_financial_transaction) for r in config.collect()] == [(2, "hi", True)]


def test_newest_and_listing(spark, tmp_path):
    for n in ("a.wav", "b.flac", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert media.audio_listing(spark, str(tmp_path)).count() == 2
    hashes = {r.file: r.sha256 for r in media.file_hashes(spark, str(tmp_path)).collect()}
    assert set(hashes) == {"a.wav", "b.flac"} and hashes["a.wav"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


@pytest.fixture(scope="module")
def rows(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    x = rng.standard_normal((400, 6)) + y[:, None] * np.array([1.5, 0, 0, 0.5, 0, 0])
    data = [(i, int(t), f"S{i % 5}", i % 40, [float(v) for v in row]) for i, (t, row) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, "audio_id long, label int, system_id string, speaker_id long, f array<double>").cache()


@pytest.mark.parametrize("kind,settings", [("random_forest", {"trees": 8, "depth": 4}), ("soft_voting", {"trees": 4, "depth": 4}), ("gradient_boosting", {"rounds": 3, "depth": 2}), ("logistic", {"rounds": 20})])
def test_models_score_in_range_and_reload(spark, rows, tmp_path, kind, settings):
    names = [f"x{i}" for i in range(6)]
    model = M.SpoofModel.fit(rows, kind, names, **settings).calibrate(rows)
    scored = model.score(rows)
    lo, hi, good = scored.agg(F.min("model_prob"), F.max("model_prob"), F.avg(((F.col("model_prob") >= model.threshold).cast("int") == F.col("label")).cast("int"))).first()
    assert 0 <= lo and hi <= 1 and good > 0.75
    path = str(tmp_path / kind)
    model.save(spark, path)
    again = M.SpoofModel.load(spark, path)
    assert again.threshold == model.threshold and again.names == names
    assert again.score(rows).select("audio_id", "model_prob").exceptAll(scored.select("audio_id", "model_prob")).count() == 0


def test_weights(rows):
    w = M.balanced_weights(rows).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(200.0) for r in w)


def test_experiment(spark, rows, tmp_path):
    model, metrics, record = experiment.run_experiment(rows, "random_forest", names=[f"x{i}" for i in range(6)], speaker_disjoint=True, trees=8, depth=4)
    row = metrics.filter("slice = 'all'").first()
    assert row.roc_auc > 0.8 and 0 <= row.eer <= 0.5 and record["train_test_shared_speakers"] == 0
    stores.write_experiment(spark, {k: v for k, v in record.items() if k != "features"}, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first().model == "random_forest"
    top = experiment.importance(model, spark).first()
    assert top.feature == "x0"


def test_experiment_on_a_balanced_universe(spark, rows):
    _, metrics, record = experiment.run_experiment(rows, "random_forest", names=[f"x{i}" for i in range(6)], recipe="balanced", size=200, speaker_disjoint=False, trees=4, depth=3)
    assert record["recipe"] == "balanced" and metrics.filter("slice = 'all'").first().n == 30
    with pytest.raises(ValueError):
        experiment.choose_universe(rows, "unknown")
