"""Products, units and pages derived from the tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, each: int = 2500) -> DataFrame:
    """``rows`` dealt by a key over tasks of about ``each``.  A table of few bytes comes in few splits however many rows it
    has; where much is made of each row, these would be few long tasks."""
    n = rows.count()
    return rows.repartition(max(1, min(n, rows.sparkSession.sparkContext.defaultParallelism), n // each), key)


#: Valid in both engines: a product's caption, name, option cell, typed specification and description.
CAPTION = "concat('[', cast(p_size % 7 + 1 as varchar(10)), '. ', p_brand, '] ', p_name, ' is made of ', lower(p_type), ' parts. It weighs ', cast(p_size * 7 as varchar(10)), 'g in its box and lasts')"
NAME = "concat('[', p_type, '][', p_brand, '] ', p_name, case when p_size % 3 = 0 then concat('(', upper(p_name), ' X)') else '' end, case when p_size % 2 = 0 then ' - Maker (AB-12)' else ' (AB-12)(NPR)' end)"
OPTION = "concat('type=1. ', p_name, ' (EGG-0', cast(p_size as varchar(10)), '),2) ', p_type, ' - OH-3650/4570099420325,03. ', p_brand, case when p_size % 5 = 0 then concat(',', p_brand, '(XL)') else '' end)"
TYPED = "concat('무게 ', cast(p_size * 3 as varchar(10)), 'g · ', cast(p_size as varchar(10)), '.5cm, 길이: ', cast(p_size as varchar(10)), '~', cast(p_size + 2 as varchar(10)), 'mm / note | 9개 | 8g')"
MEASURES = "concat(p_name, ' 무게는 약 ', cast(p_size * 3 as varchar(10)), ' g, 사이즈(mm): ', cast(p_size as varchar(10)), ' × 18x20', chr(10), '패키지 크기 40cm / 전장 ', cast(p_size as varchar(10)), 'mm / 무게 ', cast(p_size as varchar(10)), 'g대 / 본체 사이즈：60×55×', cast(p_size as varchar(10)), 'mm')"
