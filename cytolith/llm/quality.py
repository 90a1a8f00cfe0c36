"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Lower-cased words are hashed to a fixed number of columns (relative counts of unit
length); next to them stand ratios of characters and words and the log of lengths, which
are metadata of the text. The machine weighs pairs of columns through low-rank factors
and scores a row in time linear in its words by the sum-of-squares identity; Spark's own
model does both. doc_id, lang and source are no inputs: doc_id only assigns folds.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolith.llm.common import checkpointed, unused, whole_text

THRESHOLD = 0.3
FOLDS = 5
WORD_COLUMNS = 1 << 11
FACTORS = 4
#: Labelled rows that the model is fitted on at most, drawn by a hash of doc_id.
FIT_ROWS = 12_000
STEPS, STEP_SIZE, PENALTY = 80, 0.1, 1e-4

#: Characters counted per character of text.
STRUCTURE = {"upper": r"\p{Lu}", "digit": "[0-9]", "bar": "[|]", "exclaim": "[!?]", "symbol": r"[#$%&*@^~=<>{}\\/]", "stop": "[.,;:]"}
RATIO = 4.0


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo the folds; 0 is held out. A null identifier is held out."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % FOLDS).cast("int"), F.lit(0))


def _names(df: DataFrame) -> dict[str, str]:
    """Columns that are made on the way, by names that ``df`` does not have."""
    return {x: unused(df, f"__{x}") for x in ("text", "words", "counts", "unit", "features", "probability", "prediction", "raw", *STRUCTURE, "repeats", "distinct", "length", "word_length", "lines")}


def features(df: DataFrame, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the vector ``__features`` (``names`` tells how it is called). Null texts count as empty; an empty text has structure columns of zero."""
    name = names or _names(df)
    whole_words = F.filter(F.split(F.lower(name["text"]), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    whole = df.withColumn(name["text"], whole_text(text)).withColumn(name["words"], whole_words)
    words_of = name["words"]
    chars, words = F.length(name["text"]) + 1.0, F.size(words_of) + 1.0
    repeats = F.size(F.filter(F.transform(words_of, lambda w, i: w == F.get(words_of, i - 1)), lambda same: same))
    structure = {name[k]: F.least(F.lit(1.0), RATIO * F.regexp_count(name["text"], F.lit(p)) / chars) for k, p in STRUCTURE.items()}
    structure |= {
        name["repeats"]: repeats / words,
        name["distinct"]: F.size(F.array_distinct(words_of)) / words,
        name["length"]: F.log(chars) / 12,
        name["word_length"]: F.least(F.lit(1.0), chars / words / 20),
        name["lines"]: F.log(F.regexp_count(name["text"], F.lit("\n")) + 1.0) / 8,
    }
    counted = HashingTF(inputCol=words_of, outputCol=name["counts"], numFeatures=WORD_COLUMNS).transform(whole.withColumns(structure))
    unit = Normalizer(inputCol=name["counts"], outputCol=name["unit"]).transform(counted)
    whole_vector = VectorAssembler(inputCols=[name["unit"], *structure], outputCol=name["features"]).transform(unit)
    return whole_vector.drop(name["text"], words_of, name["counts"], name["unit"], *structure)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FMClassificationModel | float:
    """A machine fitted on labelled documents outside the held-out fold, ``fit_rows`` at most.

    Rows are drawn by a hash of doc_id, so the draw is the same on every run. Several
    labels of a document count as their largest. With labels of one class only, or none,
    the constant score of that class (1 without labels) is returned.
    """
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 0)
    usable = usable.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("double").alias("__label"))
    n = usable.count()
    drawn = usable.where(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * fit_rows / max(n, 1))))
    drawn = spark.createDataFrame(drawn.limit(fit_rows).collect(), drawn.schema)
    texts = docs.select(F.col("doc_id").alias("__id"), whole_text().alias("text"))
    rows = checkpointed(features(texts.join(F.broadcast(drawn), "__id")).select("__label", "__features").repartition(12))  # few rows; the scan keeps its tasks
    classes = [r[0] for r in rows.select("__label").distinct().collect()]
    if len(classes) < 2:
        return classes[0] if classes else 1.0
    machine = FMClassifier(
        featuresCol="__features",
        labelCol="__label",
        probabilityCol="__probability",
        predictionCol="__prediction",
        rawPredictionCol="__raw",
        factorSize=FACTORS,
        maxIter=STEPS,
        stepSize=STEP_SIZE,
        regParam=PENALTY,
        seed=17,
    )
    return machine.fit(rows)


def score(df: DataFrame, model: FMClassificationModel | float, text: str = "text", to: str = "quality_score") -> DataFrame:
    """``df`` with the column ``to``, from 0 to 1, higher where label 1 is likelier; a column of that name is replaced."""
    if isinstance(model, float):
        return df.withColumn(to, F.lit(model))
    name = _names(df)
    renamed = model.copy()
    for setting in ("features", "probability", "prediction", "raw"):
        renamed.set(renamed.getParam({"raw": "rawPredictionCol"}.get(setting, f"{setting}Col")), name[setting])
    scored = renamed.transform(features(df, text, name))
    value = F.get(vector_to_array(name["probability"]), F.lit(1))
    scored = scored.withColumn(to, F.coalesce(F.nanvl(value, F.lit(0.5)), F.lit(0.5)))
    return scored.select(*[c for c in df.columns if c != to], to)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` whose score reaches the threshold; all columns and repeated rows are kept, whatever the columns are called."""
    to = unused(docs, "__score")
    return score(docs, fit(docs, labels), to=to).where(F.col(to) >= threshold).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
