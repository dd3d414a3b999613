"""Everything a fitted job needs to score rows, as one stored pipeline.

A bundle is a PipelineModel of an encoder and an ensemble. Reading it back needs nothing of the run that fitted it.
"""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ..functions.probability import logit_product, weighted_sum
from . import boosting, stacking
from .encode import EncoderModel
from .stored import StoredStage

KINDS = ("mean", "blend", "stack")


class EnsembleModel(StoredStage):
    """Adds ``predict`` to rows with features.

    mean: the mean probability of all members. blend: log-odds of the members main, recent, suspicious and red_yellow, the product of the
    last two, and the sum with ``weights``. stack: mean probabilities of the members ``boosted_<i>`` and
    ``forest_<i>``, and the probability of the member ``meta`` over both.
    """

    def __init__(self, kind: str, members: dict, weights: dict | None = None):
        super().__init__()
        if kind not in KINDS:
            raise ValueError(f"no such ensemble: {kind}")
        self.kind, self.members, self.weights = kind, dict(members), dict(weights or {})

    def state(self):
        return {"kind": self.kind, "weights": self.weights, "order": list(self.members)}

    def models(self):
        return self.members

    @classmethod
    def restore(cls, state, tables, models):
        return cls(state["kind"], {n: models[n] for n in state["order"]}, state["weights"])

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != "features"]
        if self.kind == "mean":
            out = boosting.score_bag(list(self.members.values()), df)
        elif self.kind == "blend":
            out = heads(df, self.members)
            out = out.withColumn("predict", weighted_sum(self.weights))
        else:
            learners = {k: [m for n, m in self.members.items() if n.startswith(k)] for k in stacking.LEARNERS}
            out = stacking.score_stack(learners, self.members["meta"], df)
        return out.select(*keep, "predict")


def heads(rows: DataFrame, models: dict) -> DataFrame:
    """Log-odds of each model, and the product of suspicious and red_yellow."""
    for name, model in models.items():
        rows = boosting.log_odds(model, rows, name)
    return rows.withColumn("product", logit_product("suspicious", "red_yellow")).drop("features")


def bundle(encoder: EncoderModel, ensemble: EnsembleModel) -> PipelineModel:
    return PipelineModel([encoder, ensemble])


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
