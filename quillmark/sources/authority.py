"""Person records of an authority file: projection of stored responses, and the cache's age test.

Requests go out through a fetcher that the caller brings; nothing here opens a connection.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import commits

#: Seconds for which a stored response counts.
LIFETIME = 86_400
RESPONSE = (
    "struct<member:array<struct<id:string,preferredName:string,variantName:array<string>,dateOfBirth:array<string>,"
    "dateOfDeath:array<string>,professionOrOccupation:array<struct<label:string>>,sameAs:array<struct<id:string>>>>>"
)


def expression(name: str, limit: int) -> dict[str, str]:
    """Search parameters for a person's name."""
    quoted = name.strip().replace('"', '\\"')
    return {"q": f'preferredName:"{quoted}" OR variantName:"{quoted}"', "filter": "type:Person", "size": str(min(limit, 20)), "format": "json"}


def persons(responses: DataFrame) -> DataFrame:
    """name_key, gnd_id, name, variants, birth, death, occupations, url, same_as from (name_key, body)."""
    one = responses.select("name_key", F.explode(F.from_json("body", RESPONSE)["member"]).alias("p"))
    return one.select(
        "name_key", F.element_at(F.split("p.id", "/"), -1).alias("gnd_id"), F.col("p.preferredName").alias("name"), F.col("p.variantName").alias("variants"),
        F.get("p.dateOfBirth", F.lit(0)).alias("birth"), F.get("p.dateOfDeath", F.lit(0)).alias("death"), F.col("p.professionOrOccupation.label").alias("occupations"),
        F.col("p.id").alias("url"), F.col("p.sameAs.id").alias("same_as"),
    )


def lookup(cache: DataFrame, name: str, now: float, fetch: Callable[[dict[str, str]], str] | None = None, limit: int = 10) -> DataFrame:
    """Persons of a name, from the cache (name_key, body, fetched_at in seconds) if fresh, else fetched."""
    key = name.strip().casefold()
    fresh = cache.where((F.col("name_key") == key) & (F.col("fetched_at") > now - LIFETIME))
    if fetch is not None and not fresh.limit(1).count():
        fresh = cache.sparkSession.createDataFrame([(key, fetch(expression(name, limit)), now)], cache.schema)
    return persons(fresh)


#: The cache's table in its archive, and its columns.
CACHE, CACHED = "authority", "name_key string, body string, fetched_at double"


def name_key(name: Column) -> Column:
    """A name as the cache keys it: trimmed and case-folded."""
    x = F.lower(F.trim(name))
    for a, b in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def resolve(names: DataFrame, archive: commits.Snapshots, now: float, fetch: Callable[[dict[str, str]], str], limit: int = 10, calls: int = 4) -> DataFrame:
    """``asked`` and the persons of every distinct ``name``, from the archive's cache; what is not fresh there is fetched first.

    Each stale key is asked for once, on the executors in ``calls`` tasks, and what
    comes back replaces the key's old response in one commit. A name whose request
    ends with a RuntimeError, ValueError or OSError keeps its old response, if it
    has one, and is asked for again the next time. Null and blank names have no
    persons. A lost task asks again for the keys that it had not handed on.
    """
    spark = names.sparkSession
    wanted = names.select("name", name_key(F.col("name")).alias("name_key")).where("name_key <> ''").distinct()
    snapshot = archive.snapshot()
    stale = wanted.groupBy("name_key").agg(F.min("name").alias("name"))
    if CACHE in snapshot.tables:
        stale = stale.join(snapshot.read(CACHE).where(F.col("fetched_at") > now - LIFETIME), "name_key", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, name in zip(batch["name_key"], batch["name"], strict=True):
                try:
                    body = fetch(expression(name, limit))
                except (RuntimeError, ValueError, OSError):
                    continue
                yield pd.DataFrame({"name_key": [key], "body": [body], "fetched_at": [now]})

    place = f"{archive.root}/_fetched/{uuid.uuid4().hex}"
    stale.repartition(calls, "name_key").mapInPandas(ask, CACHED).write.parquet(place)  # asked once, whatever happens to the commit
    fetched = spark.read.schema(CACHED).parquet(place)
    archive.update(lambda t: t.replace(CACHE, fetched, ["name_key"]))
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return wanted.withColumnRenamed("name", "asked").join(persons(archive.read(CACHE)), "name_key").drop("name_key")
