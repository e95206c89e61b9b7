"""Tables that a run writes once and reads several times, in the folder that the cluster shares."""
import atexit
import shutil
import tempfile
import uuid

_own = []


def folder(spark):
    """The shared checkpoint folder the session names; where it names none, one of our own if all runs on this machine, removed at the end."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        if not named:
            _own.append(tempfile.mkdtemp())
            atexit.register(shutil.rmtree, _own[-1], ignore_errors=True)
        sc.setCheckpointDir(named or _own[-1])
    return sc.getCheckpointDir()


def written(df):
    """df as a table in that folder, which cuts its lineage and outlives executors."""
    at = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)
