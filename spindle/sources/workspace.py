"""Where a comparison keeps what it has staged and indexed: a private folder that goes when it closes."""

from __future__ import annotations

import shutil
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

from spindle.model import ResourceError


class Workspace:
    """Below spark.checkpoint.dir, which a cluster's executors share; only a local session may do with a temporary folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        base = spark.conf.get("spark.checkpoint.dir", None)
        self.local = None
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ResourceError("could not create the temporary index: spark.checkpoint.dir is not set")
            try:
                self.local = tempfile.mkdtemp(prefix="spindle-")
            except OSError:
                raise ResourceError("could not create the temporary index") from None
            base = f"file://{self.local}"
        self.path = f"{base.rstrip('/')}/comparison-{uuid.uuid4().hex}"

    def _file_system(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def stage(self, name: str, chunks) -> str:
        """Writes chunks of bytes to a file that executors can read."""
        path = f"{self.path}/staged/{name}"
        try:
            fs, where = self._file_system(path)
            out = fs.create(where)
        except Exception:
            raise ResourceError("could not write the temporary input") from None
        try:
            for chunk in chunks:
                try:
                    out.write(bytearray(chunk))
                except Exception:
                    raise ResourceError("could not write the temporary input") from None
        finally:
            out.close()
        return path

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """df, written and read back: later steps neither recompute it nor see sources that have changed."""
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        try:
            fs, where = self._file_system(self.path)
            fs.delete(where, True)
            if self.local:
                shutil.rmtree(self.local)
        except Exception as error:
            warnings.warn(f"could not remove temporary files: {error}", RuntimeWarning, stacklevel=2)
