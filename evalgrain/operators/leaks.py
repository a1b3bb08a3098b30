"""Private texts in public ones, secrets in settings, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrain.operators.containment import contained

# Keys whose values are secret, endings of such keys, and what is exempt.
SECRET_KEYS = (
    "api_key authorization password secret client_secret token access_token auth_token admin_token bearer_token"
    " subscription_token x_api_key x_subscription_token"
).split()
SECRET_SUFFIXES = "_api_key _password _client_secret _access_token _auth_token _admin_token _bearer_token _subscription_token".split()
EXEMPT_PREFIX, EXEMPT_PART = "allow_empty_", "fingerprint"
REDACTED = "<redacted>"


def is_secret_key(key: str) -> bool:
    name = key.strip().casefold().replace("-", "_")
    if name.startswith(EXEMPT_PREFIX) or EXEMPT_PART in name:
        return False
    return name in SECRET_KEYS or name.endswith(tuple(SECRET_SUFFIXES))


def redact(column: Column, kind: T.DataType) -> Column:
    """A nested column with the values of secret keys replaced ('' stays ''); structs, arrays and string maps."""
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            value = column.getField(f.name)
            if is_secret_key(f.name):
                empty = value.isNull() | (value.cast("string") == "") if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else value.isNull()
                value = F.when(empty, "").otherwise(REDACTED)
            else:
                value = redact(value, f.dataType)
            fields.append(value.alias(f.name))
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: redact(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
        name = lambda k: F.regexp_replace(F.lower(F.trim(k)), "-", "_")
        exempt = lambda k: name(k).startswith(EXEMPT_PREFIX) | name(k).contains(EXEMPT_PART)
        secret = lambda k: ~exempt(k) & (name(k).isin(SECRET_KEYS) | name(k).rlike("(" + "|".join(SECRET_SUFFIXES) + ")$"))
        return F.transform_values(column, lambda k, v: F.when(secret(k), F.when(F.coalesce(v, F.lit("")) == "", "").otherwise(REDACTED)).otherwise(v))
    return column


def leak_findings(texts: DataFrame, items: DataFrame, canary: str) -> DataFrame:
    """text_id, kind, item_id: questions of 20 characters or more, answers of 4 or more, and the canary."""
    asked = items.where("char_length(question) >= 20").select(F.concat(F.lit("question|"), F.col("item_id").cast("string")).alias("pattern_id"), F.col("question").alias("pattern"))
    told = items.where("char_length(answer) >= 4").select(F.concat(F.lit("answer|"), F.col("item_id").cast("string")).alias("pattern_id"), F.col("answer").alias("pattern"))
    hits = contained(texts.select("text_id", "text"), asked.unionByName(told))
    named = hits.select("text_id", F.substring_index("pattern_id", "|", 1).alias("kind"), F.regexp_extract("pattern_id", r"\|(.*)$", 1).alias("item_id"))
    canaries = texts.where(F.contains("text", F.lit(canary))).select("text_id", F.lit("canary").alias("kind"), F.lit(None).cast("string").alias("item_id"))
    return named.unionByName(canaries)


def phrase_pattern(phrase: Column) -> Column:
    """A case-insensitive pattern for a phrase that isn't part of a longer word."""
    return F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), phrase, F.lit(r"\E(?![A-Za-z0-9])"))


def redact_answers(texts: DataFrame, aliases: DataFrame, mark: str = "${candidate}") -> DataFrame:
    """texts (item_id, text) with each of the item's aliases replaced, the longest first, in one pattern per item."""
    quoted = F.transform("names", lambda a: F.concat(F.lit(r"\Q"), a, F.lit(r"\E")))
    per = aliases.where("char_length(trim(alias)) > 0").groupBy("item_id").agg(F.collect_set(F.trim("alias")).alias("names"))
    by_length = F.array_sort("names", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    per = per.withColumn("names", by_length).withColumn("pattern", F.concat(F.lit("(?i)(?<![A-Za-z0-9])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9])")))
    out = texts.join(per.select("item_id", "pattern"), "item_id", "left")
    return out.withColumn("redacted", F.when(F.col("pattern").isNull(), F.col("text")).otherwise(F.regexp_replace("text", F.col("pattern"), F.lit(mark.replace("$", r"\$"))))).drop("pattern")


def label_leaks(controllers: DataFrame, aliases: DataFrame, questions: DataFrame) -> DataFrame:
    """item_id, alias found in controller text (URLs blanked) but not in the item's question; numbers don't count."""
    names = aliases.where("NOT trim(alias) RLIKE '^[0-9.,]*$'").select("item_id", F.trim("alias").alias("alias")).distinct()
    said = controllers.select("item_id", F.regexp_replace("text", r"https?://\S+", " ").alias("text"))
    rows = said.join(names, "item_id").join(questions.select("item_id", "question"), "item_id")
    found = F.regexp_like("text", phrase_pattern(F.col("alias"))) & ~F.regexp_like(F.coalesce("question", F.lit("")), phrase_pattern(F.col("alias")))
    return rows.where(found).select("item_id", "alias").distinct()


def file_manifest(spark, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = files.select("path", F.sha2("content", 256).alias("sha256"))
    for part in exclude:
        out = out.where(~F.col("path").contains(part))
    return out


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and state (added, removed, changed) between two manifests."""
    both = old.withColumnRenamed("sha256", "old").join(new.withColumnRenamed("sha256", "new"), "path", "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def verification(checks: list[DataFrame]) -> DataFrame:
    """The union of check results (check, detail); a run passes when it is empty."""
    out = checks[0].select("check", F.col("detail").cast("string").alias("detail"))
    for more in checks[1:]:
        out = out.unionByName(more.select("check", F.col("detail").cast("string").alias("detail")))
    return out
