"""From a feature table to the vector column the learners read."""

from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.casts import category, column
from ..functions.hashing import bucket, portable_bucket
from ..operators import impute
from ..operators.lineage import materialise
from ..operators.skew import DEFAULT_POLICY, SkewPolicy, lookup_join
from .stored import StoredStage

MAX_CATEGORIES = 64
BUCKETS = 32            # steps of the running rates
HASHERS = {f.__name__: f for f in (bucket, portable_bucket)}


def running_rates(train: DataFrame, keys, label: str, order: Column, buckets: int = BUCKETS,
                  smoothing: float = fv.PRIOR_COUNT_SMOOTHING) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(key -> table, key -> its rows): per value the smoothed label rates before each bucket of ``order``, and over all rows last.

    Rows are ordered by a hash cut into ``buckets``. Entry b of ``rates`` counts the rows of buckets below b, so a row that
    is given the entry of its own bucket is never counted in its own rate; entry ``buckets`` counts every row. All keys are
    counted in one pass (grouping sets), combined before the shuffle, and a value holds ``buckets`` counts at most, so
    a hot value is no hot spot.
    """
    keys = list(keys)
    if not keys:
        return {}, {}
    counted = train.withColumn("_bucket", order).groupingSets([[k, "_bucket"] for k in keys], *keys, "_bucket").agg(
        F.grouping_id(*keys, "_bucket").alias("_set"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("hits"))
    entries = F.collect_list(F.struct(F.col("_bucket").alias("bucket"), "n", "hits"))

    def rate(b):
        return F.aggregate(
            "entries", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("hits")),
            lambda s, e: F.when(e["bucket"] < b, F.struct((s["n"] + e["n"]).alias("n"), (s["hits"] + e["hits"]).alias("hits"))).otherwise(s),
            lambda s: (s["hits"] + fv.PRIOR_NUMERATOR) / (s["n"] + smoothing))

    stored = materialise(counted.groupBy("_set", *keys).agg(entries.alias("entries")).select(
        "_set", *keys, F.transform(F.sequence(F.lit(0), F.lit(buckets)), rate).alias("rates")))
    found = {r["_set"]: r["count"] for r in stored.groupBy("_set").count().collect()}
    # grouping_id has a bit per column, set when it is not part of the group; the bucket always is
    sets = {k: ((1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))) << 1 for i, k in enumerate(keys)}
    return ({k: stored.where(F.col("_set") == n).select(k, "rates") for k, n in sets.items()},
            {k: found.get(n, 0) for k, n in sets.items()})


class Encoder:
    """How columns become features; ``fit`` gives the fitted stage.

    Categories are encoded as declared, whatever the table's size: those in ``indexed`` are indexed by frequency and stay
    categorical in the trees (values beyond the ``max_categories`` most frequent share one index); all others
    become label rates. A training row gets the rate of the rows before it in the order of a hash of ``order_by``, so its own label
    is never part of its features; any other row gets the rate of all training rows. Nulls in numeric columns, and the
    rates of unseen values, become the training median.
    """

    def __init__(self, categorical, numeric, indexed=(), max_categories: int = MAX_CATEGORIES, order_by: str = "event_id",
                 buckets: int = BUCKETS, hasher: str = "bucket", policy: SkewPolicy = DEFAULT_POLICY):
        self.indexed = [c for c in categorical if c in set(indexed)]
        self.rated = [c for c in categorical if c not in set(indexed)]
        self.numeric, self.max_categories = list(numeric), max_categories
        self.order_by, self.buckets, self.hasher, self.policy = order_by, buckets, hasher, policy

    def place(self) -> Column:
        """Where a training row stands in the order of the running rates."""
        return HASHERS[self.hasher](self.order_by, self.buckets).cast("int")

    def fit(self, train: DataFrame, label: str = "label") -> "EncoderModel":
        train = train.withColumns({c: category(c) for c in self.indexed + self.rated})
        tables, sizes = running_rates(train, self.rated, label, self.place(), self.buckets)
        labels = []
        for c in self.indexed:
            frequent = train.groupBy(c).count().orderBy(F.desc("count"), c).limit(self.max_categories - 1)
            labels.append([r[c] for r in frequent.collect()])
        fitted = EncoderModel(self, labels, {}, tables, sizes)
        inputs = self.numeric + fitted.rate_columns
        medians = impute.exact_medians(fitted.with_rates(train, F.lit(True)), inputs) if inputs else {}
        # a column without any value in training is constant
        fitted.medians = {c: 0.0 if v is None else v for c, v in medians.items()}
        return fitted


class EncoderModel(StoredStage):
    """Adds the vector ``features``.

    ``transform(df)`` encodes rows that were not trained on; ``transform_training(df, trained)`` those that were, where the column
    ``trained`` says so.
    """

    def __init__(self, encoder: Encoder, labels: list[list[str]], medians: dict, rates: dict[str, DataFrame],
                 sizes: dict[str, int]):
        super().__init__()
        self.encoder, self.labels, self.medians, self.rates = encoder, labels, medians, rates
        self.sizes = sizes
        self.rate_columns = [f"rate_{c}" for c in encoder.rated]

    def state(self):
        e = self.encoder
        return {"indexed": e.indexed, "rated": e.rated, "numeric": e.numeric, "max_categories": e.max_categories,
                "order_by": e.order_by, "buckets": e.buckets, "hasher": e.hasher, "labels": self.labels, "medians": self.medians,
                "sizes": self.sizes}

    def tables(self):
        return self.rates

    @classmethod
    def restore(cls, state, tables, models):
        e = Encoder(state["indexed"] + state["rated"], state["numeric"], state["indexed"], state["max_categories"],
                    state["order_by"], state["buckets"], state["hasher"])
        return cls(e, state["labels"], state["medians"], tables, state["sizes"])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._encode(df, None)

    def transform_training(self, df: DataFrame, trained: Column | str) -> DataFrame:
        return self._encode(df, column(trained))

    def with_rates(self, df: DataFrame, trained: Column | None) -> DataFrame:
        e, last = self.encoder, F.lit(self.encoder.buckets)
        df = df.withColumn("_place", 1 + (last if trained is None else F.when(trained, e.place()).otherwise(last)))
        for c in e.rated:
            df = lookup_join(df, self.rates[c].withColumnRenamed("rates", "_rates"), c, "left", e.policy, right_rows=self.sizes[c])
            df = df.withColumn(f"rate_{c}", F.element_at("_rates", F.col("_place"))).drop("_rates")
        return df.drop("_place")

    def _encode(self, df, trained):
        e, keep = self.encoder, df.columns
        df = df.withColumns({c: category(c) for c in e.indexed + e.rated})
        df = self.with_rates(df, trained)
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in self.medians.items()})
        places = [f"_i_{c}" for c in e.indexed]
        if e.indexed:
            index = StringIndexerModel.from_arrays_of_labels([list(x) for x in self.labels], inputCols=e.indexed,
                                                             outputCols=places, handleInvalid="keep")
            df = index.transform(df)
        inputs = places + e.numeric + self.rate_columns
        out = VectorAssembler(inputCols=inputs, outputCol="features").transform(df)
        return out.select(*[c for c in out.columns if c in keep and c != "features"], "features")
