"""Password hashing, where the optional native modules can be imported.

Argon2id and bcrypt are slow by design and have no JVM form in Spark, so they
run as Arrow-batched functions. Without the modules the functions exist but
refuse to run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ARGON2_MEMORY_KIB, ARGON2_TIME, ARGON2_LANES, BCRYPT_COST = 65536, 3, 4, 12


def sql_name(name: str) -> str:
    return "ls_" + name.lower()


def available(module: str) -> bool:
    import importlib.util

    return importlib.util.find_spec(module) is not None


def register(spark: SparkSession) -> list[str]:
    """Registers what can run here; returns the names."""
    done = []
    if available("argon2"):

        def a_hash(p: pd.Series) -> pd.Series:
            import argon2

            h = argon2.PasswordHasher(time_cost=ARGON2_TIME, memory_cost=ARGON2_MEMORY_KIB, parallelism=ARGON2_LANES)
            return p.map(lambda x: None if x is None else h.hash(x))

        def a_verify(p: pd.Series, stored: pd.Series) -> pd.Series:
            import argon2

            def one(x, s):
                if x is None or s is None:
                    return None
                try:
                    return int(argon2.PasswordHasher().verify(s, x))
                except argon2.exceptions.VerificationError:
                    return 0

            return pd.Series([one(x, s) for x, s in zip(p, stored)], dtype="Int64")

        spark.udf.register("ls_argon2id_hash", F.pandas_udf(a_hash, "string").asNondeterministic())
        spark.udf.register("ls_argon2id_verify", F.pandas_udf(a_verify, "long"))
        done += ["ls_argon2id_hash", "ls_argon2id_verify"]
    if available("bcrypt"):

        def b_hash(p: pd.Series, cost: pd.Series) -> pd.Series:
            import bcrypt

            return pd.Series([None if x is None else bcrypt.hashpw(x.encode(), bcrypt.gensalt(int(c))).decode() for x, c in zip(p, cost)])

        def b_verify(p: pd.Series, stored: pd.Series) -> pd.Series:
            import bcrypt

            return pd.Series([None if x is None or s is None else int(bcrypt.checkpw(x.encode(), s.encode())) for x, s in zip(p, stored)], dtype="Int64")

        spark.udf.register("ls_bcrypt_hash", F.pandas_udf(b_hash, "string").asNondeterministic())
        spark.udf.register("ls_bcrypt_verify", F.pandas_udf(b_verify, "long"))
        done += ["ls_bcrypt_hash", "ls_bcrypt_verify"]
    return done
