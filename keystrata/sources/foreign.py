"""Tables of other databases over JDBC, chosen by a connection URL. The driver's jar must be on the class path.

A Derby database belongs to one process. In local mode that is where all tasks run, so Spark's own JDBC source writes and reads
it. On a cluster the driver is that process while it writes: the tasks write text, which Derby imports in one transaction. What
tasks read is a copy of the closed database in a jar, which any number of processes may open, so its folder must be mounted on
all machines. A frame stands for the database as it was when read() was called."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import uuid
import zipfile
from urllib.parse import parse_qsl, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.types import EngineError

#: URL schemes, their JDBC prefix and driver class. Fixed values.
DRIVERS = {
    "sqlite": ("jdbc:sqlite:", "org.sqlite.JDBC"),
    "postgres": ("jdbc:postgresql://", "org.postgresql.Driver"),
    "postgresql": ("jdbc:postgresql://", "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://", "com.mysql.cj.jdbc.Driver"),
    "derby": ("jdbc:derby:", "org.apache.derby.jdbc.EmbeddedDriver"),
}


def options(url: str) -> dict[str, str]:
    """JDBC options of sqlite:///file, postgres://user:pass@host:port/db, mysql://... and derby:///folder (which comes with
    Spark, and is made where it is missing)."""
    u = urlsplit(url)
    if u.scheme not in DRIVERS:
        raise EngineError("unsupported", f"connection scheme {u.scheme}")
    prefix, driver = DRIVERS[u.scheme]
    if u.scheme == "derby":
        return {"url": f"{prefix}{u.path};create=true", "driver": driver}
    out = {"url": prefix + (u.path[1:] if u.scheme == "sqlite" else f"{u.hostname or 'localhost'}{f':{u.port}' if u.port else ''}{u.path}"), "driver": driver}
    out |= {k: v for k, v in (("user", u.username), ("password", u.password)) if v} | dict(parse_qsl(u.query))
    return out


def read(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """split: (column, lowest, highest, partitions) to read in parallel; filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").options(**(copied(spark, url) if _apart(spark, url) else options(url))).option("dbtable" if table else "query", table or query)
    if split:
        reader = reader.options(partitionColumn=split[0], lowerBound=split[1], upperBound=split[2], numPartitions=split[3])
    return reader.load()


def write(df: DataFrame, url: str, table: str, mode: str = "append", connections: int | None = None) -> None:
    """connections: how many tasks write at a time at most."""
    if _apart(df.sparkSession, url):
        return imported(df, url, table, mode)
    writer = df.write.format("jdbc").options(**options(url)).option("dbtable", table)
    (writer.option("numPartitions", connections) if connections else writer).mode(mode).save()


# --- a database of one process, on a cluster ---------------------------------------------------------------------------
def _apart(spark: SparkSession, url: str) -> bool:
    return urlsplit(url).scheme == "derby" and not spark.sparkContext._jsc.isLocal()


def _connection(spark: SparkSession, url: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(url, jvm.java.util.Properties())


def _close(spark: SparkSession, url: str) -> None:
    """After this another process may open the database, and its files are whole."""
    try:
        _connection(spark, f"jdbc:derby:{urlsplit(url).path};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() not in ("08006", "XJ004"):  # it is closed now, or was not there
            raise


def _field(spark: SparkSession, f: T.StructField) -> Column:
    """A quoted value, or nothing for NULL, as Derby's import reads them."""
    c = F.col(f"`{f.name.replace('`', '``')}`")
    text = c.cast("string")
    if isinstance(f.dataType, T.BinaryType):
        text = F.hex(c)
    elif isinstance(f.dataType, T.TimestampType):  # JDBC's are in the JVM's zone, whatever the session's
        utc = F.expr("TIMESTAMP_NTZ'1970-01-01'") + F.make_dt_interval(secs=F.unix_micros(c).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"))
        text = F.convert_timezone(F.lit("UTC"), F.lit(spark.sparkContext._jvm.java.util.TimeZone.getDefault().getID()), utc).cast("string")
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))


def imported(df: DataFrame, url: str, table: str, mode: str) -> None:
    """Spark makes the table, tasks write the rows as text beside it, Derby imports them; then the database is closed."""
    from keystrata.sources.scratch import scratch

    spark = df.sparkSession
    folder = scratch(spark, "import").removeprefix("file:")
    if not folder.startswith("/"):
        raise EngineError("unsupported", f"Derby needs a shared folder that is mounted, not {folder}")
    folder = f"/{folder.lstrip('/')}"
    own = options(url)
    parts = [p.replace('""', '"') if p else q.upper() for p, q in re.findall(r'"((?:[^"]|"")+)"|([^."]+)', table)]
    try:
        db = _connection(spark, own["url"])
        try:
            schema = parts[-2] if len(parts) > 1 else db.getSchema()
            there = db.getMetaData().getTables(None, schema, parts[-1], None).next()
        finally:
            db.close()
        if mode == "ignore" and there:
            return
        df.limit(0).write.format("jdbc").options(**own).option("dbtable", table).mode(mode).save()
        if not df.columns:
            return
        of = spark.read.format("jdbc").options(**own).option("dbtable", table).load().columns
        into = [next((x for x in of if x == c), None) or next((x for x in of if x.lower() == c.lower()), c) for c in df.columns]
        told = Observation()
        lines = df.select(F.concat_ws(",", *(_field(spark, f) for f in df.schema)).alias("line"))
        lines.observe(told, F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes")).write.text(f"file://{folder}")
        with open(f"{folder}.csv", "wb") as out:
            for name in sorted(os.listdir(folder)):
                if name.startswith("part-"):
                    with open(f"{folder}/{name}", "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 20)
                    os.remove(f"{folder}/{name}")
        if (size := os.path.getsize(f"{folder}.csv")) != told.get["bytes"]:
            raise EngineError("io_error", f"{folder} is not the same folder for the driver and the tasks: {size} bytes of {told.get['bytes']}")
        if size:
            db = _connection(spark, own["url"])
            try:
                call = db.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(?, ?, ?, NULL, ?, ',', '\"', 'UTF-8', 0)")
                for i, v in enumerate((schema, parts[-1], ",".join(into), f"{folder}.csv"), 1):
                    call.setString(i, v)
                call.execute()
            finally:
                db.close()
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        if os.path.exists(f"{folder}.csv"):
            os.remove(f"{folder}.csv")
        _close(spark, url)


def copied(spark: SparkSession, url: str) -> dict[str, str]:
    """JDBC options of a copy in a jar, made anew when the database's files have changed. Stored, so that pages are found by
    their offset."""
    top = urlsplit(url).path.rstrip("/")
    if not os.path.exists(f"{top}/service.properties") or os.path.exists(f"{top}/db.lck"):  # new, or not closed: opening recovers it, or is refused
        _connection(spark, options(url)["url"]).close()
        _close(spark, url)
    files = sorted(os.path.relpath(os.path.join(d, x), top) for d, _, names in os.walk(top) for x in names if not x.endswith(".lck") and os.path.relpath(d, top).split("/")[0] != "tmp")
    state = [(f, (s := os.stat(f"{top}/{f}")).st_size, s.st_mtime_ns) for f in files]
    jar = f"{top}-{hashlib.sha256(repr(state).encode()).hexdigest()[:32]}.jar"
    if not os.path.exists(jar):
        made = f"{jar}.{uuid.uuid4().hex}"
        with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as z:
            for f in files:
                z.write(f"{top}/{f}", f"db/{f}")
        os.replace(made, jar)
    return {"url": f"{DRIVERS['derby'][0]}jar:({jar})db", "driver": DRIVERS["derby"][1]}
