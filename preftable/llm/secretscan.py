"""Secret scan with a random forest that removes false findings, in DataFrame operations only.

Candidates are blank-separated words: those with a digit whose value (what follows ``=`` or ``:``, without
quotes, closing marks and what trails a closing quote) has at least ``MIN_LENGTH`` characters, and, of any
length and with or without digits, every value named as a key (``password=...``) or after a word that
names one (``password: ...``). Which of them are secrets is for the forest to say. Each gets features:

* length;
* character transitions: changes between letters and digits, of case, and runs of one class;
* dictionary coverage: the share of its characters in letter runs that are words of the corpus
  (seen at least ``MIN_SEEN`` times as plain words, counted over all texts);
* path: whether the word looks like a path or address (slashes, dots, at signs), and how often the
  document's source has candidates;
* neighbouring words: whether the name before ``=`` or the words before it speak of keys, whether
  the neighbours are dictionary words.

A forest (Spark ML) is trained on labelled findings, at most ``TRAIN_ROWS`` of them (a documented
bound; all findings are scored). Without labels of both kinds nothing can be learnt and every
finding is kept, with a null score.

Defined cases: null and empty texts have no findings; repeated rows give their findings again, as do
rows that share an id; findings of rows with a null id have no dictionary coverage and those of a null
source a rate of 0; a score of exactly 0.5 is a secret; a table without rows gives no rows; other columns
are ignored; whole texts are read.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preftable.llm.scratch import staged

MIN_LENGTH = 12
MIN_SEEN = 3
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 30, 6, 17
KEY_WORDS = r"(?i)(passw|pwd|secret|token|api|key|auth|cred)"
NAMED = r"^([A-Za-z_][A-Za-z0-9_.-]*)(?:=|:(?!//))[\"']?(.+)$"  # an address's scheme is no name
LABEL = KEY_WORDS + r"[A-Za-z0-9_.-]*[\"']?[=:]$"  # a word that names the next one

FEATURES = (
    "length", "digit_changes", "case_changes", "n_classes", "digit_share", "upper_share", "coverage", "n_slashes",
    "n_dots", "n_at", "source_rate", "has_name", "name_is_key", "before_is_key", "before_in_dictionary", "after_in_dictionary",
)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, word_no, name, value, before, after`` of every candidate."""
    some = df.filter(F.col(text_col).rlike("[0-9]") | F.col(text_col).rlike(KEY_WORDS)).select(F.col(id_col), F.col(source_col).alias("source"), F.split(text_col, r"[\x20\x09-\x0D]+").alias("w"))
    marked = lambda x: x.contains("=") | x.contains(":")
    at = F.filter(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda i: ((F.length(F.get("w", i)) >= MIN_LENGTH) & F.get("w", i).rlike("[0-9]"))
        | (marked(F.get("w", i)) & F.get("w", i).rlike(r"^[\"'(\[<]*[A-Za-z0-9_.-]*" + KEY_WORDS + r"[A-Za-z0-9_.-]*[=:]."))
        | F.coalesce(marked(F.get("w", i - 1)) & F.get("w", i - 1).rlike(LABEL), F.lit(False)),
    )
    rows = some.select(id_col, "source", "w", F.explode(at).alias("word_no"))
    word = F.regexp_replace(F.get("w", F.col("word_no")), r"^[\"'(\[<]+|[\"')\]>.,;:!?]+$", "")
    before = F.concat_ws(" ", F.get("w", F.col("word_no") - 2), F.get("w", F.col("word_no") - 1))
    rows = rows.select(id_col, "source", "word_no", word.alias("word"), before.alias("before"), F.get("w", F.col("word_no") + 1).alias("after"))
    has = F.col("word").rlike(NAMED)
    rows = rows.withColumn("name", F.when(has, F.regexp_extract("word", NAMED, 1)))
    value = F.when(has, F.regexp_extract("word", NAMED, 2)).otherwise(F.col("word"))
    rows = rows.withColumn("value", F.regexp_replace(value, r"[\"'][^\p{L}0-9]*$", ""))
    keyed = F.coalesce(F.col("name").rlike(KEY_WORDS), F.lit(False)) | F.col("before").rlike(LABEL)
    whole = (F.length("value") >= MIN_LENGTH) & F.col("value").rlike("[0-9]")
    return rows.filter(whole | (keyed & (F.length("value") > 0))).select(id_col, "source", "word_no", "name", "value", "before", "after")


def dictionary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``part``: plain words (lower-case letters, three or more) seen ``MIN_SEEN`` times in all texts."""
    words = df.select(F.explode(F.split(text_col, r"[\x20\x09-\x0D]+")).alias("w"))
    plain = words.select(F.lower(F.regexp_replace("w", r"[.,;:!?]+$", "")).alias("part")).filter(F.col("part").rlike(r"^\p{L}{3,}$"))
    return plain.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SEEN).select("part")


def _parts(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), 1))


def features(found: DataFrame, words: DataFrame, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``found`` (a written table) with its features and a row key."""
    key = [id_col, "word_no", "value"]
    near = F.concat_ws(" ", F.regexp_extract("before", r"(\S+)$", 1), F.coalesce("after", F.lit("")))
    parts = found.select(*key, F.explode(F.array_union(_parts(F.col("value")), _parts(near))).alias("part")).distinct()
    known = staged(parts.select("part").distinct().join(words, "part", "left_semi"), "dictionary")
    covered = parts.join(known, "part").groupBy(*key).agg(F.collect_set("part").alias("known"))
    totals = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("docs"))
    rates = found.groupBy("source").agg(F.count(F.lit(1)).alias("hits")).join(totals, "source").select("source", (F.col("hits") / F.col("docs")).alias("source_rate"))
    rows = found.join(covered, key, "left").join(rates, "source", "left")
    known_set = F.coalesce("known", F.array().cast("array<string>"))
    v = F.col("value")
    runs = F.regexp_extract_all(F.lower(v), F.lit(r"(\p{L}{3,})"), 1)
    in_words = F.aggregate(F.filter(runs, lambda x: F.array_contains(known_set, x)), F.lit(0), lambda a, x: a + F.length(x))
    size = F.length(v)
    count = lambda pattern, c=v: F.regexp_count(c, F.lit(pattern))
    in_dictionary = lambda text: F.arrays_overlap(known_set, _parts(text))
    made = {
        "length": size,
        "digit_changes": (count(r"(?<=[0-9])(?=\p{L})") + count(r"(?<=\p{L})(?=[0-9])")) / size,
        "case_changes": (count(r"(?<=\p{Ll})(?=\p{Lu})") + count(r"(?<=\p{Lu})(?=\p{Ll})")) / size,
        "n_classes": sum((v.rlike(p).cast("int") for p in (r"\p{Lu}", r"\p{Ll}", r"[0-9]", r"[^\p{L}0-9]")), F.lit(0)),
        "digit_share": count("[0-9]") / size,
        "upper_share": count(r"\p{Lu}") / size,
        "coverage": in_words / size,
        "n_slashes": count(r"[/\\]"),
        "n_dots": count(r"\."),
        "n_at": count("@"),
        "source_rate": F.coalesce("source_rate", F.lit(0.0)),
        "has_name": F.col("name").isNotNull(),
        "name_is_key": F.coalesce(F.col("name").rlike(KEY_WORDS), F.lit(False)),
        "before_is_key": F.coalesce(F.col("before").rlike(KEY_WORDS), F.lit(False)),
        "before_in_dictionary": F.coalesce(in_dictionary(F.regexp_extract("before", r"(\S+)$", 1)), F.lit(False)),
        "after_in_dictionary": F.coalesce(in_dictionary(F.col("after")), F.lit(False)),
    }
    return rows.select(*found.columns, *[F.coalesce(made[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def forest(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """A forest fitted on rows with features and ``label`` (0 or 1), or None if a label is missing.

    At most ``train_rows`` rows, evenly from both labels and in hash order, train it.
    """
    sides = []
    for y in (0, 1):
        own = labelled.filter(F.col("label") == y).select("label", *FEATURES)
        sides.append(own.orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(train_rows // 2))
    if any(s.isEmpty() for s in sides):
        return None
    sample = staged(sides[0].unionByName(sides[1]).withColumn("label", F.col("label").cast("double")), "forest-rows")
    grow = RandomForestClassifier(labelCol="label", featuresCol="v", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="v"), grow]).fit(sample)


def scored(rows: DataFrame, model) -> DataFrame:
    """``rows`` with ``score`` (the forest's share for a secret) and ``is_secret``."""
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    out = model.transform(rows).withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return out.drop("v", "rawPrediction", "probability", "prediction").withColumn("is_secret", F.col("score") >= 0.5)


def format_label() -> Column:
    """A label from the finding's form alone, null where the form doesn't tell: 1 for issued key formats and
    long hex values named as keys, 0 for addresses, card and telephone numbers and versions."""
    v = F.col("value")
    keyed = F.coalesce(F.col("name"), F.col("before")).rlike(KEY_WORDS)
    secret = v.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$") | (keyed & v.rlike(r"^[0-9a-f]{16,}$"))
    other = v.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]+$") | v.rlike(r"^[0-9][0-9 ()+.,:/-]*$") | v.rlike(r"^[a-z]+://") | v.rlike(r"^\p{L}+[0-9]{1,2}$")
    return F.when(secret, 1).when(other, 0)


def find_secrets(df: DataFrame, labels: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every finding: ``id, source, word_no, name, value, before, after, label, score, is_secret``.

    ``labels`` is a column over a finding (1 secret, 0 not, null unknown); by default ``format_label``.
    """
    found = staged(candidates(df, id_col, text_col, source_col).withColumn("label", format_label() if labels is None else labels), "findings")
    rows = staged(features(found, dictionary(df, text_col), df, id_col, source_col), "finding-features")
    return scored(rows, forest(rows.filter("label is not null"))).drop(*FEATURES)
