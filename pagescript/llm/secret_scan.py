"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions only.

A candidate is any run of at least MIN_LENGTH characters of tokens and keys, or any of eight that is assigned. Passwords hold other marks
too: a quoted value that is assigned goes on to its quote, a bare one after a credential's name to what ends words in shells and query
strings; both are printable ASCII and end at blanks. Its features are its length, its character
transitions, how much of it dictionary words cover, hints in the path, and the words around it. The forest is fitted on labelled
findings: (the same features, label). Where no such table exists, weak_labels() labels a bounded sample of the candidates by rules
that are right about what they label.

Texts are searched once: runs() of all of them are written to the shared folder, and labels, features and verdicts come from there.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, let, written

MIN_LENGTH = 12
CUTOFF = 0.5
_C = r"A-Za-z0-9_+/\-"
#: Right before an assigned value; before a bare one of a credential.
_ASSIGNED = "(?<=[=:]|[=:][\"'` ]|[=:] [\"'`])"
_NAMED = "(?<=(?i:pass|passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)[A-Za-z0-9_.-]{0,12}[\"'`]? ?[=:] ?)"
#: Values in each kind of quote, and bare ones, which don't end in the marks that end sentences.
_QUOTED = "(?<=\")[!#-~]{8,}+|(?<=')[!-&(-~]{8,}+|(?<=`)[!-_a-~]{8,}+"
_BARE = r"[!#-%*+\-./0-9:=?@A-Z\\^_a-z~]{7,}[#-%*+\-/0-9=@A-Z\\^_a-z~]"
#: A run of token characters, or an assigned value. Looked at once from its start, with no way back but over marks at the end, so
#: long words cost no more than their length.
_FOUND = rf"(?<![{_C}])(?:{_ASSIGNED}(?:{_QUOTED}|{_NAMED}{_BARE}|[{_C}]{{8,}}+)|[{_C}]{{{MIN_LENGTH},}}+)={{0,2}}"

# Common words and word parts, names of credentials, signs of examples, prefixes of well-known key formats.
DICTIONARY = "the|and|ing|ion|tion|ent|est|ere|her|ther|this|that|with|for|from|are|was|not|you|all|con|com|pre|pro|der|die|und|ein|sch|ich|ung|que|les|des|ent|ment|eau|aux|los|las|ado|cion|mente|http|www|org|test|example|sample|user|name|file|data|code|line|text|page|list|item|value|index|class|type|time|date|number|string|version|release"
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
EXAMPLE = r"(?i)(\b(example|sample|dummy|placeholder|changeme|test)\b|\byour[_-]|xxxx)"
KNOWN_FORMAT = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^xox[abprs]-|^sk_live_|^AIza[0-9A-Za-z_\-]{35}$"

FEATURES = ["length", "digits", "uppers", "lowers", "others", "case_changes", "kind_changes", "distinct", "vowels", "hex_only", "covered", "path_hint", "credential_before", "assigned", "quoted", "example_near", "words_before"]


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def runs(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, text_hash, path, ordinal (from 0 in each text), candidate, before, after; written to the shared folder.

    docs: (doc_id, text) and, if named, a column with a path. Texts without a candidate, null and empty ones give no row. Whole texts:
    the text is cut at its candidates, so each keeps its own neighbours. Repeated candidates are rows of their own, as are those of
    repeated rows and ids.
    """
    text = F.col("text")
    parts = F.struct(F.regexp_extract_all(text, F.lit(_FOUND), F.lit(0)).alias("runs"), F.split(text, _FOUND).alias("gaps"))  # one gap more than candidates
    zipped = let(
        parts,
        lambda s: F.transform(s["runs"], lambda c, i: F.struct(c.alias("candidate"), F.right(F.get(s["gaps"], i), F.lit(40)).alias("before"), F.left(F.get(s["gaps"], i + 1), F.lit(20)).alias("after"))),
    )
    with_any = docs.where(text.rlike(_FOUND)).select("doc_id", F.xxhash64("text").alias("text_hash"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), zipped.alias("found"))
    near = with_any.select("doc_id", "text_hash", "path", F.posexplode("found").alias("ordinal", "x")).select("doc_id", "text_hash", "path", "ordinal", "x.*")
    return written(near, "secret-runs")


def features(near: DataFrame) -> DataFrame:
    """runs() without their path + FEATURES."""
    c = F.col("candidate")
    known = near.withColumns(
        {
            "length": F.length(c).cast("double"),
            "digits": _share(c, "[0-9]"),
            "uppers": _share(c, "[A-Z]"),
            "lowers": _share(c, "[a-z]"),
            "others": _share(c, "[^A-Za-z0-9]"),
            "case_changes": _share(c, "(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
            "kind_changes": _share(c, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
            "vowels": _share(c, "[aeiouAEIOU]"),
            "hex_only": c.rlike("^[0-9a-f]+$").cast("double"),
            "covered": 1 - F.length(F.regexp_replace(F.lower(c), DICTIONARY, "")) / F.length(c),
            "path_hint": F.coalesce(F.col("path").rlike(EXAMPLE), F.lit(False)).cast("double"),
            "credential_before": F.col("before").rlike(CREDENTIAL).cast("double"),
            "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
            "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
            "example_near": (F.col("before").rlike(EXAMPLE) | F.col("after").rlike(EXAMPLE) | c.rlike(EXAMPLE)).cast("double"),
            "words_before": F.regexp_count("before", F.lit("[A-Za-z]{2,}")).cast("double"),
        }
    )
    return known.drop("path")


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The candidates of runs() with their FEATURES."""
    return features(runs(docs, path))


def weak_labels(found: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """Labelled findings from candidates: FEATURES + label, at most most_rows of each label (those of least hash).

    1: a well-known key format, or an assignment to a credential of a value with digits and without dictionary words. 0: runs that
    are examples by themselves or by the name that they are assigned to, digits alone, and runs with neither digits nor many case
    changes unless they are assigned to a credential. Everything else stays unlabelled.
    """
    c = F.col("candidate")
    known = c.rlike(KNOWN_FORMAT)
    secret = (F.col("credential_before") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0.15) & (F.col("covered") < 0.3)
    to_credential = (F.col("credential_before") == 1) & (F.col("assigned") == 1)
    harmless = ((F.col("digits") == 0) & (F.col("case_changes") < 0.2) & ~to_credential) | (F.col("digits") == 1)
    name = F.regexp_extract("before", r"([\w.\-]+)[\"'`]?\s*[=:]\s*[\"'`]?$", 1)
    example = c.rlike(EXAMPLE) | name.rlike(EXAMPLE) | F.translate(name, "_-.", "   ").rlike(EXAMPLE)
    labelled = found.withColumn("label", F.when(known, 1.0).when(example, 0.0).when(harmless, 0.0).when(secret, 1.0)).where("label IS NOT NULL")
    # Counts by range of hashes tell which ranges hold the most_rows of least hash; only these are sorted.
    order = F.xxhash64("candidate", "before")
    near = F.shiftright(order, 52).cast("int")
    counts = sorted((r.label, r.near, r["count"]) for r in labelled.groupBy("label", near.alias("near")).count().collect())
    pick = []
    for y in (0.0, 1.0):
        last, held = -(1 << 11), 0
        for _, at, n in (c for c in counts if c[0] == y):
            if held < most_rows:
                last, held = at, held + n
        pick.append(labelled.where((near <= last) & (F.col("label") == y)).orderBy(order, "doc_id", "ordinal").limit(most_rows).select("label", *FEATURES))
    return pick[0].unionAll(pick[1])


def fit(labelled: DataFrame, trees: int = 24, depth: int = 7, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest on labelled findings (FEATURES, label 0 or 1); None if one of the labels does not occur."""
    rows = cut(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled.where("label IS NOT NULL")).select("features", "label").repartition(4))
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(rows)


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """candidates() with probability (null without a model) and is_secret: all of them, the forest's verdict beside each.

    Without a model every candidate that stands after a credential's name or has a known format counts.
    """
    if model is None:
        rule = F.col("candidate").rlike(KNOWN_FORMAT) | (F.col("credential_before") * F.col("assigned") == 1)
        return found.withColumn("probability", F.lit(None).cast("double")).withColumn("is_secret", rule)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    probability = vector_to_array("probability")[1]
    return scored.withColumn("p", probability).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("p", "probability").withColumn("is_secret", F.col("probability") >= CUTOFF)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None, path: str | None = None) -> DataFrame:
    """judge() of the candidates of docs."""
    return judge(candidates(docs, path), model)


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of found replaced in its document's text, and n_chars (if there is one) counted anew.

    Secrets belong to a text, told by doc_id and a hash of the text, so rows that share an id, null included, are searched for their own
    alone. The longest secrets go first, so one that is part of another leaves nothing of it. Documents without a finding keep their
    rows as they are.
    """
    secrets = cut(found.where("is_secret").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of")).agg(F.collect_set("candidate").alias("_secrets")))
    whole = docs.select(F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"))
    joined = whole.join(broadcast_if_small(secrets), F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_of")), "left")
    longest_first = F.transform(F.sort_array(F.transform("_secrets", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))), asc=False), lambda x: x["s"])
    clean = F.aggregate(longest_first, F.col("_text"), lambda t, s: F.replace(t, s, F.lit(mark)))
    text = F.when(F.col("_secrets").isNotNull(), clean).otherwise(F.col("_text"))
    out = joined.select("_secrets", "_in", text.alias("_text"))
    made = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        made["n_chars"] = F.when(F.col("_secrets").isNotNull(), F.length("_text").cast(kind)).otherwise(F.col("_in.n_chars"))
    return out.select(*[made.get(c, F.col("_in")[c]).alias(c) for c in docs.columns])
