"""Secret findings, of which a random forest removes the false ones. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import cut

# Different labelled findings the forest is fitted on, half of them of either class; its trees and their depth.
FIT_ROWS, TREES, DEPTH = 20_000, 24, 7
# Occurrences that make a run of letters a word of the dictionary.
WORD_COUNT = 5
# Bytes of words that candidates are made of, up to which they are sent to all tasks that count words.
SENT_WORDS = 8 << 20
# Features that weak labels of true findings are read from.
CONTEXT = ("quoted", "near_credential", "assigned", "before_bucket")
# All features of what stands around a candidate.
NEIGHBOURS = (*CONTEXT, "near_sample", "near_digest", "after_letters")
_RUN = r"[A-Za-z0-9+/_=-]{16,}"
_CREDENTIAL = r"(?i)(token|secret|passw|pwd|key|auth|bearer|credential)"
# A value with a digit given to a credential's name within one word, which is no address with parameters.
_GIVEN = r"(?i)^[^?&/]*(token|secret|passw|pwd|key|auth|bearer|credential)[A-Z_]*[\"'`]?[:=][\"'`]?(?=[^ ]*[0-9])[A-Z0-9+/_-]{8,}"
# Beginnings and lengths that issuers of keys have made public.
_ISSUED = (
    r"^(AKIA|ASIA)[A-Z0-9]{16}$",
    r"^gh[oprsu]_[A-Za-z0-9]{36}$",
    r"^glpat-[A-Za-z0-9_-]{20}$",
    r"^xox[abprs]-[A-Za-z0-9-]{16,}$",
    r"^[rs]k_live_[A-Za-z0-9]{16,}$",
    r"^AIza[A-Za-z0-9_-]{35}$",
)
_DIGEST = r"(?i)\b(commit|sha-?[0-9]+|md5|checksum|digest|revision|etag)\b"
_SAMPLE = r"(?i)(test|example|sample|mock|fixture|demo|doc)"


def _neighbour(words: Column, at: Column) -> Column:
    return F.coalesce(F.get(words, at), F.lit(""))


def _issued() -> Column:
    return F.col("candidate").rlike("|".join(_ISSUED))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``id``, ``at`` (word number), ``nth`` in the word, ``candidate``, its ``word``, its neighbours and ``path``.

    A candidate is a run of at least 16 letters, digits and ``+/_=-`` with a digit, with a capital after a small letter, or as an issuer writes its keys.
    """
    words = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0B\f\r]+", -1).alias("words"),
    )
    long = F.filter(
        F.transform("words", lambda w, i: F.when(F.length(w) >= 16, F.struct(i.alias("at"), w.alias("word")))),
        lambda x: x.isNotNull(),
    )
    placed = words.withColumn("long", long).filter(F.size("long") > 0)
    around = F.transform(
        "long",
        lambda x: F.struct(
            x["at"].alias("at"),
            x["word"].alias("word"),
            F.concat_ws(" ", *[_neighbour(F.col("words"), x["at"] + k) for k in (-3, -2, -1)]).alias("before"),
            _neighbour(F.col("words"), x["at"] + 1).alias("after"),
        ),
    )
    found = placed.select("id", "path", F.explode(around).alias("x")).select("id", "path", "x.*")
    runs = F.regexp_extract_all("word", F.lit(f"({_RUN})"), F.lit(1))
    return (
        found.select("id", "path", "at", "word", "before", "after", F.posexplode(runs).alias("nth", "candidate"))
        .filter(F.col("candidate").rlike("[0-9]|[a-z][A-Z]") | _issued())
    )


def _dictionary_cover(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``candidate``, ``cover``: the share of its characters in runs of letters that are words of the corpus.

    Words are counted over all texts with map-side combination, candidates once each. Only words that candidates are made
    of matter; up to ``SENT_WORDS`` bytes of them go to the tasks, which then drop all others before the shuffle.
    """
    letters = r"[^\p{L}]+"
    # Words of a name may also be told by their capitals.
    parted = F.regexp_replace("candidate", "(?<=[a-z])(?=[A-Z])", " ")
    words = docs.select(
        F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), letters)).alias("w")
    ).filter(F.length("w") >= 3)
    runs = (
        found.select("candidate")
        .distinct()
        .select("candidate", F.explode(F.split(F.lower(parted), letters)).alias("w"))
        .filter(F.length("w") >= 3)
    )
    wanted = cut(runs.select("w").distinct(), "wanted")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("w") + 32), F.lit(0))).first()[0]
    if size <= SENT_WORDS:
        words = words.join(F.broadcast(wanted), "w", "left_semi")
    words = words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= WORD_COUNT)
    covered = runs.join(words, "w").groupBy("candidate").agg(F.sum(F.length("w")).alias("covered"))
    return covered.select("candidate", (F.col("covered") / F.length("candidate")).alias("cover"))


def _features() -> dict[str, Column]:
    c, word, before = F.col("candidate"), F.col("word"), F.col("before")
    n = F.length(c).cast("double")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    flag = lambda test: test.cast("double")
    return {
        "length": n,
        # Changes between letters and digits, and between small letters and capitals.
        "letter_digit": count(c, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "case_change": count(c, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "digits": count(c, "[0-9]") / n,
        "capitals": count(c, "[A-Z]") / n,
        "marks": count(c, "[+/_=-]") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "repeats": count(c, r"(.)(?=\1)") / n,
        "hexadecimal": flag(c.rlike("^[0-9a-fA-F]+$")),
        "cover": F.coalesce("cover", F.lit(0.0)),
        "slashes": count(word, "/"),
        "dots": count(word, r"\."),
        "at_sign": flag(F.contains(word, F.lit("@"))),
        "quoted": flag(word.rlike("[\"'`]")),
        "path_depth": count(F.col("path"), "/"),
        "path_sample": flag(F.col("path").rlike(_SAMPLE)),
        "near_credential": flag(F.concat_ws(" ", before, word).rlike(_CREDENTIAL)),
        "near_sample": flag(F.concat_ws(" ", before, F.col("after")).rlike(_SAMPLE)),
        "near_digest": flag(F.concat_ws(" ", before, word).rlike(_DIGEST)),
        "assigned": flag(before.rlike("[:=]$") | word.rlike("[A-Za-z_][\"']?[:=][\"']?[A-Za-z0-9]")),
        "before_bucket": F.pmod(F.hash(F.regexp_extract(before, r"(\S*)$", 1)), F.lit(64)).cast("double"),
        "after_letters": flag(F.col("after").rlike(r"^\p{L}+")),
    }


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """All candidates with their features, written once."""
    found = cut(candidates(docs, id_col, text_col, path_col), "candidates")
    cover = _dictionary_cover(found, docs, text_col)
    features = _features()
    joined = found.join(cover, "candidate", "left")
    return cut(
        joined.select("id", "at", "nth", "candidate", "word", "before", "after", "path", F.array(*features.values()).alias("x")),
        "findings",
    )


def weak_label(found: DataFrame) -> DataFrame:
    """Label findings whose kind is certain: ``label`` 1 for a quoted value given to a credential's name, a value with a
    digit given to one within a word, and a key as its issuer writes them; 0 for a card
    number with a valid checksum, a run of dictionary words with hardly a digit, one of under four different characters and
    32 or more hexadecimal digits behind the name of a digest.

    All others, bare runs among them, and those that are both stay unlabelled (null).
    """
    feature = lambda name: F.get("x", F.lit(list(_features()).index(name)))
    secret = F.col("word").rlike("^[\"'`]?" + _RUN + "[\"'`]") & F.col("before").rlike(_CREDENTIAL + r"\S*\s*[:=]$")
    secret = secret | F.col("word").rlike(_GIVEN) | _issued()
    card = F.col("candidate").rlike("^[0-9]{16,19}$") & F.call_function("luhn_check", F.col("candidate"))
    bare = feature("digits") + feature("marks")
    compound = (feature("cover") + bare >= 0.9) & (feature("cover") >= 0.6) & (feature("digits") <= 0.1)
    digest = F.col("candidate").rlike("^[0-9a-fA-F]{32,}$") & F.col("before").rlike(_DIGEST)
    other = card | compound | digest | (F.size(F.array_distinct(F.split("candidate", ""))) < 4)
    return found.withColumn("label", F.when(secret & ~other, 1.0).when(other & ~secret, 0.0))


def _planted(sample: DataFrame, features: Sequence[str]) -> DataFrame:
    """Labelled true rows of the sample among the neighbours of labelled false ones, which do not speak of a digest.

    Both are numbered by a hash and meet in turn; the sample is bounded, so one task may number it.
    """
    names = list(_features())
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("x"), "x")) - 1
    plain = F.get("x", F.lit(names.index("near_digest"))) == 0
    kinds = sample.filter((F.col("label") == 1) | plain).select("x", "n", "label", place.alias("k"))
    lenders = kinds.filter(F.col("label") == 0).select(F.col("x").alias("around"), F.col("k").alias("turn"))
    count = lenders.count()
    if not count:
        return sample.limit(0)
    met = kinds.filter(F.col("label") == 1).join(lenders, F.col("k") % count == F.col("turn"))
    parts = [F.get("around" if name in features else "x", F.lit(i)) for i, name in enumerate(names)]
    return met.select(F.array(*parts).alias("x"), "label", "n")


def scan_secrets(
    found: DataFrame, labelled: DataFrame, threshold: float = 0.5, without: Sequence[str] = (), planted: Sequence[str] = ()
) -> DataFrame:
    """``id``, ``at``, ``nth``, ``candidate``, ``score`` of the findings that the forest takes for secrets.

    ``found``: from ``described``; ``labelled``: rows of the same columns and ``label`` (0, 1 or null for unknown). The
    forest looks at all features but those named in ``without`` and scores every finding. Labelled rows of equal features
    and label count as one with a weight; it is fitted on at most ``FIT_ROWS`` / 2 such of either class, those of smallest hash,
    whose weights add up to the rows of their class. Where labels of true rows were read from features, ``planted`` names
    these: each true row then counts half as it is and half with those features taken from a false row, so that a
    secret is also known by its own characters where nothing around it gives it away. With no
    labelled rows, or one class only, every score is the smoothed share of true ones. Null texts have no findings, null
    paths count as empty. Repeated rows give repeated findings. An empty table gives an empty result.
    """
    names = list(_features())
    plain = lambda frame: frame.select("*", *[F.get("x", F.lit(k)).alias(f"f_{n}") for k, n in enumerate(names)])
    vector = VectorAssembler(
        inputCols=[f"f_{n}" for n in names if n not in without], outputCol="features", handleInvalid="keep"
    )
    known = labelled.filter(F.col("label").isNotNull())
    kinds = cut(known.groupBy("x", "label").agg(F.count("*").alias("n")), "labelled")
    total = {r.label: r.n for r in kinds.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    n, good = sum(total.values()), total.get(1.0, 0)
    if 0 < good < n:
        few = [kinds.filter(F.col("label") == k).orderBy(F.xxhash64("x"), "x").limit(FIT_ROWS // 2) for k in total]
        sample = cut(few[0].unionByName(few[1]), "sample")
        if planted:
            sample = cut(sample.unionByName(_planted(sample, planted)), "sample")
        held = {r.label: r.n for r in sample.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        share = F.when(F.col("label") == 1, F.lit(total[1.0] / held[1.0])).otherwise(F.lit(total[0.0] / held[0.0]))
        forest = RandomForestClassifier(
            labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=32
        ).fit(vector.transform(plain(sample.withColumn("weight", F.col("n") * share))))
        scored = forest.transform(vector.transform(plain(found))).withColumn(
            "score", vector_to_array("probability")[1]
        )
    else:
        scored = found.withColumn("score", F.lit((good + 1) / (n + 2)))
    return scored.filter(F.col("score") >= threshold).select("id", "at", "nth", "candidate", "score")
