"""Class files in folders, jars and jmods as rows."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASS = "location string, name string, access int, super string, interfaces array<string>, methods array<struct<name:string,desc:string,access:int>>, fields array<struct<name:string,desc:string,access:int>>, size long"
#: Sizes of constant-pool entries by tag, past the tag; strings (tag 1) have their own length.
_POOL = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


def parse(data: bytes) -> dict:
    """Name, access, super class, interfaces, methods and fields of a class file."""
    if data[:4] != b"\xca\xfe\xba\xbe":
        raise ValueError("no class file")
    n, at, pool = struct.unpack_from(">H", data, 8)[0], 10, {}
    i = 1
    while i < n:
        tag = data[at]
        if tag == 1:
            size = struct.unpack_from(">H", data, at + 1)[0]
            pool[i] = data[at + 3 : at + 3 + size].decode("utf-8", "replace")
            at += 3 + size
        else:
            if tag == 7:
                pool[i] = struct.unpack_from(">H", data, at + 1)[0]
            at += 1 + _POOL[tag]
        i += 2 if tag in (5, 6) else 1

    def u2() -> int:
        nonlocal at
        at += 2
        return struct.unpack_from(">H", data, at - 2)[0]

    def class_name(k: int) -> str | None:
        return pool[pool[k]].replace("/", ".") if k else None

    def members() -> list[dict]:
        nonlocal at
        out = []
        for _ in range(u2()):
            access, name, desc = u2(), pool[u2()], pool[u2()]
            for _ in range(u2()):
                at += 2
                at += 4 + struct.unpack_from(">I", data, at)[0]
            out.append({"name": name, "desc": desc, "access": access})
        return out

    access, name, sup = u2(), class_name(u2()), class_name(u2())
    interfaces = [class_name(u2()) for _ in range(u2())]
    fields = members()
    return {"name": name, "access": access, "super": sup, "interfaces": interfaces, "methods": members(), "fields": fields, "size": len(data)}


def classes(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per class under paths (folders, .class, .jar, .jmod files). Files are read by Spark's own reader, so any store works."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).where(F.col("path").rlike(r"\.(class|jar|jmod)$")).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["location", "name", "access", "super", "interfaces", "methods", "fields", "size"]
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                if path.endswith(".class"):
                    parts = [content]
                else:
                    z = zipfile.ZipFile(io.BytesIO(content[4:] if content[:2] == b"JM" else content))
                    parts = (z.read(n) for n in z.namelist() if n.endswith(".class") and not n.endswith("module-info.class"))
                for p in parts:
                    rows.append({"location": path, **parse(bytes(p))})
            yield pd.DataFrame(rows, columns=cols)

    return files.mapInPandas(run, CLASS)


def hierarchy_edges(rows: DataFrame) -> DataFrame:
    """edges(child, parent, location, is_class) of classes()."""
    up = F.explode(F.concat(F.when(F.col("super").isNotNull(), F.array(F.struct(F.col("super").alias("parent"), F.lit(True).alias("is_class")))).otherwise(F.array().cast("array<struct<parent:string,is_class:boolean>>")),
                            F.transform("interfaces", lambda i: F.struct(i.alias("parent"), F.lit(False).alias("is_class")))))
    return rows.select(F.col("name").alias("child"), "location", up.alias("e")).select("child", "e.parent", "location", "e.is_class")


def manifest_class_path(manifests: DataFrame) -> DataFrame:
    """(location, entry) of manifests(location, text): entries of Class-Path, continuation lines joined."""
    joined = F.regexp_replace("text", r"\r?\n ", "")
    entries = F.split(F.trim(F.regexp_extract(joined, r"(?m)^Class-Path:\s*(.*)$", 1)), r"\s+")
    return manifests.select("location", F.explode(entries).alias("entry")).where("entry <> ''")
