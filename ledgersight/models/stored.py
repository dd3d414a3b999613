"""Fitted stages that Spark ML pipelines can store and read back, tables and nested models included."""

from pyspark.ml import Model, Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path):
        models = self.stage.models()
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={
            "state": self.stage.state(), "models": {n: type(m).__name__ for n, m in models.items()},
            "tables": sorted(self.stage.tables())})
        for name, df in self.stage.tables().items():
            df.write.option("compression", "zstd").parquet(f"{path}/tables/{name}")
        for name, model in models.items():
            model.write().save(f"{path}/models/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        from pyspark.ml import classification, feature
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        kinds = {n: getattr(classification, k, None) or getattr(feature, k) for n, k in found["models"].items()}
        stage = self.cls.restore(
            found["state"], {n: self.sparkSession.read.parquet(f"{path}/tables/{n}") for n in found["tables"]},
            {n: kind.read().load(f"{path}/models/{n}") for n, kind in kinds.items()})
        stage._resetUid(found["uid"])
        return stage


class StoredStage(Transformer, MLReadable, MLWritable):
    """A fitted stage made of a JSON state, tables and models.

    Tables are written as Parquet by the executors; only the state is JSON.
    """

    def state(self) -> dict:
        raise NotImplementedError

    def tables(self) -> dict[str, DataFrame]:
        return {}

    def models(self) -> dict[str, Model]:
        return {}

    @classmethod
    def restore(cls, state: dict, tables: dict[str, DataFrame], models: dict[str, Model]):
        raise NotImplementedError

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)
