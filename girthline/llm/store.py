"""Tables that stages of one operator hand on: Parquet in the shared folder, dropped once nothing reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from girthline.session import shared_folder


class Store:
    """Keeps the tables of one run. Unlike checkpoints they are compressed, have known sizes, carry no constraints of the plans that
    made them (which grow with every round of a loop), and go when they are told to."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[kept] = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of these tables; no DataFrame that reads them may be used afterwards."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all(self, but: tuple[DataFrame, ...] = ()) -> None:
        """Deletes all tables but these and those that these read."""
        needed = {file.rsplit("/", 1)[0] for t in but for file in t.inputFiles()}
        self.drop(*(t for t, path in list(self.paths.items()) if not any(f.endswith(path.split(":", 1)[-1]) for f in needed)))
