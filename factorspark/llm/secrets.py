"""Secret scanning in DataFrame functions: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least 12 key characters with a digit, or a value assigned to a credential word. Its features
are plain column expressions: length, transitions between character classes, coverage by dictionary words, the shape of a
path, and the words and marks beside it. The forest is trained by Spark's own learner on labelled findings and then
written out as column expressions, so a text is scanned, judged and redacted in one pass without a shuffle.

Labelled findings are a table ``value, before, after, label``. Where none is kept, ``labelled`` takes those candidates of a corpus that leave
no doubt: a long hexadecimal or mixed value assigned to a credential word is a secret; parts of addresses, paths, hosts, numbers and words are not.

Defined cases: a null or empty text has no candidates and stays as it is. Repeated candidates are found each by itself. Texts
are scanned whole. Without labelled findings of both kinds, scores are the share of secrets among them (0.5 without any).
An empty table gives an empty result. Extra columns are not read; ``redacted`` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of keys, and what is taken for a candidate.
KEY = "A-Za-z0-9_+/.-"
CREDENTIAL = r"(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth(?:orization)?|credentials?|bearer)"
RUN = rf"(?<![{KEY}])(?=[A-Za-z_+/.-]*+[0-9])[{KEY}]{{12,}}+={{0,2}}"
ASSIGNED = rf"(?<=[:=][ \t]?[\"']?)(?<={CREDENTIAL}[\"']?[ \t]?[:=][ \t]?[\"']?)[^\s\"']{{6,}}"
PATTERN = f"(?i:{ASSIGNED})|{RUN}"
PLACEHOLDER = "[secret]"
#: Characters of context kept on either side.
BEFORE, AFTER = 48, 16
#: Labelled findings used for training, at most, and words of the dictionary, at most.
SAMPLE, DICTIONARY = 20_000, 20_000
TREES, DEPTH, SEED = 15, 5, 11

FEATURES = ("length", "digits", "uppers", "class_changes", "alternation", "hex", "distinct", "dictionary", "path_marks", "credential_before", "assigned", "quoted", "address", "words_beside")


def parts(text: Column) -> Column:
    """Array of ``value, before, after, gap``: each candidate, the text beside it, and all text since the candidate before it."""
    values = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    gaps = F.split(text, PATTERN, -1)
    zipped = F.arrays_zip(values.alias("value"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    return F.transform(F.filter(zipped, lambda p: p["value"].isNotNull()), lambda p: F.struct(
        p["value"].alias("value"), F.right(p["gap"], F.lit(BEFORE)).alias("before"), F.left(p["next"], F.lit(AFTER)).alias("after"), p["gap"].alias("gap")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, value, before, after`` of every candidate; positions count characters from 0."""
    text = F.col(text_col).cast("string")
    rows = docs.where(F.regexp_like(text, F.lit(PATTERN))).select(F.col(id_col).alias("doc_id"), parts(text).alias("parts"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("parts", none, lambda a, p: F.struct(
        (a["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("at"), F.array_append(a["starts"], a["at"] + F.length(p["gap"])).alias("starts")))
    rows = rows.select("doc_id", F.explode(F.arrays_zip("parts", starts["starts"].alias("start"))).alias("c"))
    start, value = F.col("c.start"), F.col("c.parts.value")
    return rows.select("doc_id", start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.col("c.parts.before").alias("before"), F.col("c.parts.after").alias("after"))


def _share(value: Column, pattern: str) -> Column:
    """Share of the characters that match."""
    return F.length(F.regexp_replace(value, pattern, "")).cast("double") / F.length(value)


def features(value: Column, before: Column, after: Column, dictionary: Sequence[str]) -> list[Column]:
    """The forest's inputs, in the order of ``FEATURES``."""
    size = F.length(value).cast("double")
    lower = F.lower(value)
    runs = F.split(lower, "[^a-z]+", -1)
    known = F.aggregate(F.filter(runs, lambda w: w.isin(list(dictionary)) if dictionary else F.lit(False)), F.lit(0), lambda a, w: a + F.length(w))
    changes = F.size(F.split(value, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", -1)) - 1
    alternation = F.size(F.split(lower, r"(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])", -1)) - 1
    beside = F.size(F.filter(F.split(F.lower(before), "[^a-z]+", -1), lambda w: w.isin(list(dictionary)) if dictionary else F.lit(False)))

    def flag(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(0.0)

    return [
        size, 1 - _share(value, "[0-9]"), 1 - _share(value, "[A-Z]"), changes / size, alternation / size, 1 - _share(lower, "[0-9a-f]"),
        F.size(F.array_distinct(F.split(value, "(?!^)", -1))) / F.least(size, F.lit(32.0)), known / size, 1 - _share(value, "[/.:-]"),
        flag(F.regexp_like(before, F.lit(rf"(?i){CREDENTIAL}[^A-Za-z]{{0,6}}$"))), flag(F.regexp_like(before, F.lit(r"[=:]\s*[\"']?$"))),
        flag(F.regexp_like(before, F.lit("[\"']$")) & F.regexp_like(after, F.lit("^[\"']"))),
        flag(F.regexp_like(before, F.lit(r"(@|://\S*|/)$")) | F.regexp_like(after, F.lit(r"^(@|://)"))), beside.cast("double"),
    ]


def labelled(found: DataFrame) -> DataFrame:
    """``value, before, after, label`` of the candidates that leave no doubt, for corpora without reviewed findings."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    named = F.regexp_like(before, F.lit(rf"(?i){CREDENTIAL}[\"']?\s*[:=]\s*[\"']?$"))
    mixed = F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]"))
    secret = named & mixed & F.regexp_like(value, F.lit(r"^(?:[0-9a-fA-F]{32,}|[A-Za-z0-9_+/=-]{20,})$"))
    address = F.regexp_like(before, F.lit(r"(@|://\S*)$")) | F.regexp_like(after, F.lit(r"^(@|://)"))
    plain = F.regexp_like(value, F.lit(r"^[0-9.+/-]+$|^[a-z]{2,}[./-][a-z]{2,}|\.(?:com|org|net|html?|js|css|png|jpg)\b|^/|^[A-Za-z]+[0-9]{0,4}[.]?$"))
    label = F.when(secret, 1.0).when(~named & (address | plain), 0.0)
    rows = found.select("value", "before", "after", label.alias("label")).where("label is not null")
    # Each secret once more without its credential word and quotes, so that its own form is learned and not the assignment alone.
    bare = rows.where("label = 1").withColumn("before", F.regexp_replace("before", rf"(?i){CREDENTIAL}[\"']?\s*[:=]\s*[\"']?$", "")).withColumn("after", F.regexp_replace("after", "^[\"']", ""))
    return rows.unionByName(bare)


def dictionary_of(texts: DataFrame, text_col: str = "text", most: int = DICTIONARY, least: int = 4) -> list[str]:
    """The most frequent words of a reference table of plain texts, at most ``most``; ties in the order of letters."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z]+", -1)).alias("word")).where(F.length("word") >= least)
    return [r["word"] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).collect()]


@dataclass(frozen=True)
class Forest:
    """Trees as nested ``(feature, threshold, left, right)`` or a leaf's 0.0 or 1.0; ``constant`` where none could be trained."""

    trees: tuple = ()
    constant: float | None = None
    dictionary: tuple[str, ...] = ()

    def score(self, columns: Sequence[Column]) -> Column:
        """Share of the trees that vote for a secret."""
        if self.constant is not None:
            return F.lit(self.constant)

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(columns[feature] <= threshold, walk(left)).otherwise(walk(right))

        total = walk(self.trees[0])
        for tree in self.trees[1:]:
            total = total + walk(tree)
        return total / len(self.trees)


def _tree(lines: list[tuple[int, str]]):
    """A tree from its printed form: an If and an Else line at one depth, each followed by its branch."""
    depth, head = lines[0]
    if head.startswith("Predict"):
        return float(head.split(":")[1])
    feature, threshold = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", head).groups()
    other = next(i for i, (d, line) in enumerate(lines) if i and d == depth and line.startswith("Else"))
    return int(feature), float(threshold), _tree(lines[1:other]), _tree(lines[other + 1:])


def trees_of(printed: str) -> tuple:
    """All trees of a trained forest's printed form."""
    out: list[list[tuple[int, str]]] = []
    for line in printed.splitlines():
        if line.strip().startswith("Tree "):
            out.append([])
        elif out and line.strip():
            out[-1].append((len(line) - len(line.lstrip()), line.strip()))
    return tuple(_tree(lines) for lines in out)


def trained(findings: DataFrame, dictionary: Sequence[str] = (), sample: int = SAMPLE) -> Forest:
    """A forest from labelled findings: at most ``sample``, taken by the order of a hash, half of each label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    columns = features(F.col("value"), F.col("before"), F.col("after"), dictionary)
    rows = findings.where("value is not null and label in (0, 1)").withColumn("place", F.xxhash64("value", "before", "after"))
    parts_ = [rows.where(F.col("label") == x).orderBy("place").limit(sample // 2) for x in (0, 1)]
    rows = parts_[0].unionByName(parts_[1]).select(*(c.alias(n) for c, n in zip(columns, FEATURES, strict=True)), F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="inputs").transform(rows).select("inputs", "label").persist()
    try:
        counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(counts) < 2:
            return Forest(constant=next(iter(counts), 0.5), dictionary=tuple(dictionary))
        model = RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(rows)
    finally:
        rows.unpersist()
    return Forest(trees_of(model.toDebugString), dictionary=tuple(dictionary))


def judged(found: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """Candidates with ``score`` and ``secret``."""
    names = [f"_{n}" for n in FEATURES]
    columns = features(F.col("value"), F.col("before"), F.col("after"), forest.dictionary)
    rows = found.select("*", *(c.alias(n) for c, n in zip(columns, names, strict=True)))
    return rows.select(*found.columns, forest.score([F.col(n) for n in names]).alias("score")).withColumn("secret", F.col("score") >= threshold)


def redacted(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced; other columns and other texts stay as they are."""
    text = F.col(text_col).cast("string")

    def measured(p: Column) -> Column:
        inputs = F.struct(*(c.alias(n) for c, n in zip(features(p["value"], p["before"], p["after"], forest.dictionary), FEATURES, strict=True)))
        return F.struct(p["gap"].alias("gap"), p["value"].alias("value"), inputs.alias("inputs"))

    def kept(p: Column) -> Column:
        secret = forest.score([p["inputs"][n] for n in FEATURES]) >= threshold
        return F.concat(p["gap"], F.when(secret, F.lit(PLACEHOLDER)).otherwise(p["value"]))

    gaps = F.split(text, PATTERN, -1)
    rebuilt = F.concat(F.array_join(F.transform(F.transform(parts(text), measured), kept), ""), F.element_at(gaps, -1))
    return docs.withColumn(text_col, F.when(F.regexp_like(text, F.lit(PATTERN)), rebuilt).otherwise(text))
