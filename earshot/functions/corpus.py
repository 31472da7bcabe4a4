"""Path parsing and corpus classification rules (PRJ-01 .. PRJ-05, PRJ-16, PRJ-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col

# Names searched in paths, in order of preference.
SPEECH_LANGUAGES = ["hindi", "tamil", "telugu", "bengali", "kannada", "marathi"]
SYNTH_LANGUAGES = SPEECH_LANGUAGES + ["malayalam", "gujarati"]
GENERATORS = ["xttsv2", "vits", "freevc24", "freevc", "yourtts"]
# Language codes.
LANGUAGE_OF_CODE = {"hi": "hindi", "ta": "tamil", "te": "telugu", "bn": "bengali", "kn": "kannada", "mr": "marathi"}


def first_match(text, names: list[str], default) -> Column:
    """PRJ-02: the first name of the list that occurs in the lower-cased text."""
    low = F.lower(as_col(text))
    return F.coalesce(*[F.when(low.contains(n), F.lit(n)) for n in names], as_col(default) if isinstance(default, Column) else F.lit(default))


def file_name(path) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def parent_name(path) -> Column:
    return F.coalesce(F.try_element_at(F.split(as_col(path), "/"), F.lit(-2)), F.lit(""))


def stem(path) -> Column:
    """PRJ-03: file name without the audio suffix."""
    return F.regexp_replace(file_name(path), r"\.wav|\.flac", "")


def id_part(stem_col, separator: str, index: int) -> Column:
    """PRJ-03: zero-based part of a split id, NULL when there are too few parts."""
    return F.get(F.split(as_col(stem_col), separator), F.lit(index))


def pseudo_speaker(stem_col, buckets: int = 30) -> Column:
    """PRJ-04: stable bucket of a stem."""
    number = F.conv(F.substring(F.md5(as_col(stem_col)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(buckets)).cast("int")


def language_name(code, default=None) -> Column:
    """PRJ-16: code to name."""
    lookup = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF_CODE.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, as_col(code)), F.lit(default))


def language_code(name, default=None) -> Column:
    """PRJ-16: name to code."""
    lookup = F.create_map(*[F.lit(x) for k, v in LANGUAGE_OF_CODE.items() for x in (v, k)])
    return F.coalesce(F.try_element_at(lookup, as_col(name)), F.lit(default))


def valid_file(duration, channels, rate) -> Column:
    """PRJ-05."""
    return (as_col(duration) >= 0.5) & (as_col(channels) == 1) & (as_col(rate) == 16000)


def default_speaker(speaker, position, speakers: int) -> Column:
    """PRJ-17: the given speaker, or a round-robin number for a zero-based position."""
    return F.coalesce(as_col(speaker).cast("string"), (F.pmod(as_col(position), F.lit(speakers)) + 1).cast("string"))


def classify_paths(
    clips: DataFrame,
    path: str = "path",
    protocol: DataFrame | None = None,
    trials: DataFrame | None = None,
    token_fallback: bool = True,
) -> DataFrame:
    """PRJ-01 with JOIN-01/JOIN-02: ordered first-match rules give corpus, speaker, system and label.

    ``protocol`` (audio_id, speaker_id, system_id, label) and ``trials`` (same columns) are joined by
    stem; Spark picks a broadcast or a shuffle from their sizes. ``token_fallback`` matches ``nat`` in
    the last rule as a whole token instead of any substring.
    """
    df = clips.withColumn("audio_id", stem(path)).withColumn("_low", F.lower(F.col(path)))
    df = df.withColumn("_file", F.lower(file_name(path)))

    def attach(left, side, prefix, extra=None):
        if side is None:
            return left.withColumns({f"_{prefix}_{c}": F.lit(None).cast(t) for c, t in
                                     [("speaker", "string"), ("system", "string"), ("label", "int")]})
        # one entry per id, so that a repeated protocol line cannot repeat a clip
        entry = F.max(F.struct("system_id", "speaker_id", F.col("label").cast("int").alias("label")))
        right = side.groupBy(F.col("audio_id").alias(f"_{prefix}_id")).agg(entry.alias("e")).select(
            f"_{prefix}_id", F.col("e.speaker_id").alias(f"_{prefix}_speaker"), F.col("e.system_id").alias(f"_{prefix}_system"), F.col("e.label").alias(f"_{prefix}_label"))
        on = F.col("audio_id") == F.col(f"_{prefix}_id")
        return left.join(right, on if extra is None else on & extra, "left")

    is_trial_path = F.col("_low").contains("asvspoof2021") | F.col("audio_id").startswith("DF_E_")
    df = attach(df, protocol, "p")
    df = attach(df, trials, "t", is_trial_path)

    low, name = F.col("_low"), F.col("_file")
    part = lambda sep, i: id_part("audio_id", sep, i)
    slr = low.contains("slr65")
    extra_lang = first_match(low, SPEECH_LANGUAGES, F.when(slr, F.lit("tamil")).otherwise("indian_lang"))
    synth_lang = first_match(low, SYNTH_LANGUAGES, "indian_lang")
    generator = first_match(low, GENERATORS, "synthetic")
    parent = parent_name(path)
    parent = F.when(parent.isin("train", "dev", "test"), parent).otherwise("gen")

    rules = [
        (
            "additional_genuine",
            low.contains("additional_genuine"),
            F.when(slr, F.when(part("_", 1).isNotNull(), F.concat_ws("_", part("_", 0), part("_", 1)))
                   .otherwise(F.concat(F.lit("slr65_"), part("_", 0))))
            .otherwise(F.format_string("fleurs_%s_%s_spk%02d", extra_lang, parent, pseudo_speaker("audio_id"))),
            F.when(slr, F.lit("indic_slr65_tamil")).otherwise(F.concat(F.lit("indic_fleurs_"), extra_lang)),
            F.lit(0),
        ),
        (
            "indic_tts",
            low.contains("indic_tts") | low.contains("indictts"),
            F.coalesce(part("_", 2), F.concat(F.lit("indictts_"), synth_lang, F.lit("_spk"))),
            F.concat(F.lit("indictts_"), synth_lang),
            F.lit(0),
        ),
        (
            "indic_synth",
            low.contains("indic_synth") | low.contains("indicsynth"),
            F.coalesce(part("_", 3), F.concat(F.lit("synth_"), generator, F.lit("_"), synth_lang, F.lit("_spk"))),
            F.concat(F.lit("indicsynth_"), generator, F.lit("_"), synth_lang),
            F.lit(1),
        ),
        ("asvspoof2019", F.col("_p_system").isNotNull(), F.col("_p_speaker"), F.col("_p_system"), F.col("_p_label")),
        ("asvspoof2021", is_trial_path & F.col("_t_system").isNotNull(), F.col("_t_speaker"), F.col("_t_system"), F.col("_t_label")),
        (
            "asvspoof2021_unlisted",
            is_trial_path,
            F.lit("speaker_unknown"),
            F.lit("asv2021_df"),
            F.when(name.contains("bonafide") | name.contains("genuine"), 0).otherwise(1),
        ),
        ("librispeech", low.contains("librispeech"), F.concat(F.lit("libri_"), part("-", 0)), F.lit("bonafide"), F.lit(0)),
        (
            "chatterbox",
            low.contains("chatterbox") | low.contains("phonemedf"),
            F.lit("chatterbox_speaker"),
            F.lit("chatterbox_tts"),
            F.lit(1),
        ),
    ]
    # file-name rule for the 2019 adjusted set, then the fallback on name fragments
    named = file_name(path).contains("ASV2019")
    three = part("-", 2).isNotNull()
    named_system = F.when(three, part("-", 1)).when(name.contains("nat"), "bonafide").otherwise("spoof")
    genuine_word = name.contains("bonafide") | name.contains("genuine")
    nat = name.rlike(r"(^|[^a-z])nat([^a-z]|$)") if token_fallback else name.contains("nat")
    fallback_genuine = nat | name.contains("bona") | name.contains("genuine")
    rules.append(
        (
            "asv2019_named",
            named,
            F.when(three, part("-", 0)).otherwise("speaker_unknown"),
            named_system,
            F.when(F.lower(named_system).isin("nat", "bonafide") | genuine_word, 0).otherwise(1),
        )
    )
    rules.append(
        (
            "fallback",
            F.lit(True),
            F.lit("speaker_unknown"),
            F.when(fallback_genuine, "bonafide").otherwise("spoof"),
            F.when(fallback_genuine, 0).otherwise(1),
        )
    )

    def chain(pick):
        out = F.lit(None)
        for rule in reversed(rules):
            out = F.when(rule[1], pick(rule)).otherwise(out)
        return out

    df = df.withColumns(
        {
            "corpus": chain(lambda r: F.lit(r[0])),
            "speaker_id": chain(lambda r: r[2]),
            "system_id": chain(lambda r: r[3]),
            "label": chain(lambda r: r[4]).cast("int"),
        }
    )
    # the three-part name also renames the clip
    renamed = (F.col("corpus") == "asv2019_named") & part("-", 2).isNotNull()
    df = df.withColumn("audio_id", F.when(renamed, part("-", 2)).otherwise(F.col("audio_id")))
    df = df.withColumn("label_str", F.when(F.col("label") == 0, "genuine").otherwise("spoof"))
    return df.drop(*[c for c in df.columns if c.startswith("_")])
