"""Scoring requests: JSON bodies with typed values, accepted or refused as a whole.

A request is one body: a JSON array of profiles, or one profile. Its elements are read as VARIANT, which keeps
the type every value was written with, so that 12 is a number and "12" is not. Rules hold for a request, in the
order of ``RULES``; the first that fails refuses all of its rows and is reported with the columns at fault:

* ``invalid_json``: unparsable, repeated keys in an object, neither array nor object, null, empty, or without any profile;
* ``not_a_table``: an element that is no object;
* ``missing_columns``: a feature that no profile of the request has;
* a continuous feature: a text, boolean or nested value, a number out of bounds, or no number at all (nulls beside
  numbers pass);
* ``binary``: a feature that is absent, null or other than 0, 1, true, false, "0" or "1" in any profile.

The id of a row is the value of the request's first id column (in the order in which keys appear), as text; a
request without one gets ``CLIENT_1`` .. ``CLIENT_n`` by position.

A row carries three bit masks (one bit a feature: has the key, holds a number, is at fault), and a request's
verdict is their bitwise or: one partial aggregate, however large a request is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.config import CONTINUOUS_FEATURES, FEATURES, ID_ALIASES, ID_PREFIX
from attrition.operators.score import Artifacts, score_rows
from attrition.session import checkpoint_root

RULES = ["invalid_json", "not_a_table", "missing_columns", *CONTINUOUS_FEATURES, "binary"]
#: Lowest value of a continuous feature, and whether it is itself allowed.
BOUNDS = {"tenure": (0.0, True), "MonthlyCharges": (0.0, False)}


def request_bodies(spark: SparkSession, path: str, per_line: bool = False, stream: bool = False,
                   max_files: int | None = None) -> DataFrame:
    """(request, body) of a folder of text files: a file is one request, or with ``per_line`` each line that is
    not blank. ``request`` is the file's path, with the line's number behind it: the same whenever it is read."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("request"), F.col("value").alias("body"))
    if not per_line:
        return files
    lines = files.select("request", F.posexplode(F.split("body", "\r?\n")).alias("line", "body"))
    return lines.where(F.trim("body") != "").select(F.concat("request", F.lit("#"), (F.col("line") + 1).cast("string")).alias("request"), "body")


def _field(f: str) -> Column:
    return F.try_variant_get("_v", f"$['{f}']", "variant")


def _kind(value: Column) -> Column:
    """number, text, boolean, null, nested; null if the key is absent."""
    t = F.schema_of_variant(value)
    return (F.when(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), F.lit("number")).when(t == "STRING", F.lit("text"))
            .when(t == "BOOLEAN", F.lit("boolean")).when(t == "VOID", F.lit("null")).when(t.isNotNull(), F.lit("nested")))


def _mask(conditions) -> Column:
    """Bit i is set where the i-th condition holds."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def parse_requests(bodies: DataFrame, features=tuple(FEATURES)) -> DataFrame:
    """request, pos (0-based, null for a body without profiles), _json, _object, _ids, every feature as double, and
    the masks _has, _number, _bad. A body without profiles is one row, so that no request is lost."""
    features = list(features)
    if len(features) > 63:
        raise ValueError("a mask holds 63 features")
    text = F.trim(F.regexp_replace("body", r"^[\s﻿]+|\s+$", ""))
    whole = F.when(F.right(text, F.lit(1)).isin("]", "}"), F.try_parse_json(text)).otherwise(F.lit(None))
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    # beside the explode, the body would be parsed again for each of its elements
    whole_bodies = bodies.select("request", "body", whole.isNotNull().alias("_json"))
    rows = whole_bodies.select("request", "_json", F.posexplode_outer(F.when(F.col("_json"), F.from_json(listed, "array<string>"))).alias("pos", "_text"))
    rows = rows.withColumn("_v", F.try_parse_json("_text"))
    rows = rows.withColumn("_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    rows = rows.withColumns({f"_k_{f}": _kind(_field(f)) for f in features})

    def value(f):
        v, kind = F.try_variant_get("_v", f"$['{f}']", "double"), F.col(f"_k_{f}")
        if f in CONTINUOUS_FEATURES:
            return F.when(kind == "number", v)
        asis = F.try_variant_get("_v", f"$['{f}']", "string")
        return (F.when(kind == "number", v).when(kind == "boolean", F.when(asis == "true", 1.0).otherwise(0.0))
                .when((kind == "text") & asis.isin("0", "1"), asis.cast("double")))

    rows = rows.withColumns({f: value(f) for f in features})

    def bad(f):
        kind = F.col(f"_k_{f}")
        if f in BOUNDS:
            low, closed = BOUNDS[f]
            out = F.col(f) < low if closed else F.col(f) <= low
            return kind.isin("text", "boolean", "nested") | F.coalesce(out | F.isnan(f), F.lit(False))
        return ~F.coalesce(F.col(f).isin(0.0, 1.0), F.lit(False))

    aliases = F.filter(F.json_object_keys("_text"), lambda k: F.lower(k).isin(*ID_ALIASES))
    return rows.select(
        "request", "pos", "_json", "_object", *features,
        _mask([F.col(f"_k_{f}").isNotNull() for f in features]).alias("_has"),
        _mask([F.col(f"_k_{f}") == "number" for f in features]).alias("_number"),
        F.when(F.col("_object"), _mask([bad(f) for f in features])).otherwise(F.lit(0)).alias("_bad"),
        # the keys in their order: a VARIANT does not keep it
        F.when(F.size(aliases) > 0, F.struct("pos", F.array_position(F.json_object_keys("_text"), aliases[0]).alias("at"), aliases[0].alias("key"))).alias("_first_id"),
        F.map_filter(F.from_json("_text", "map<string,string>"), lambda k, _: F.lower(k).isin(*ID_ALIASES)).alias("_ids"))


def request_verdicts(rows: DataFrame, features=tuple(FEATURES)) -> DataFrame:
    """request, n_rows, accepted, rule (null if accepted), columns (those at fault, in feature order), _id_key."""
    features = list(features)
    g = rows.groupBy("request").agg(
        F.count("pos").alias("n_rows"), F.bool_and("_json").alias("_json"), F.bool_and("_object").alias("_object"),
        F.bit_or("_has").alias("_has"), F.bit_or("_number").alias("_number"), F.bit_or("_bad").alias("_bad"),
        F.min("_first_id").alias("_first"))

    def bit(mask, f):
        return F.col(mask).bitwiseAND(F.lit(1 << features.index(f)).cast("long")) != 0

    def named(fs, condition):
        return F.array_compact(F.array(*[F.when(condition(f), F.lit(f)) for f in fs]))

    rule = (F.when(~F.col("_json") | (F.col("n_rows") == 0), F.lit("invalid_json"))
            .when(~F.col("_object"), F.lit("not_a_table"))
            .when(F.col("_has") != (1 << len(features)) - 1, F.lit("missing_columns")))
    for c in [c for c in CONTINUOUS_FEATURES if c in features]:
        rule = rule.when(bit("_bad", c) | ~bit("_number", c), F.lit(c))
    binary = [f for f in features if f not in CONTINUOUS_FEATURES]
    rule = rule.when(F.size(named(binary, lambda f: bit("_bad", f))) > 0, F.lit("binary"))
    g = g.withColumn("rule", rule)
    columns = (F.when(F.col("rule") == "missing_columns", named(features, lambda f: ~bit("_has", f)))
               .when(F.col("rule") == "binary", named(binary, lambda f: bit("_bad", f)))
               .when(F.col("rule").isin(*CONTINUOUS_FEATURES), F.array("rule")).otherwise(F.array().cast("array<string>")))
    return g.select("request", "n_rows", F.col("rule").isNull().alias("accepted"), "rule", columns.alias("columns"), F.col("_first.key").alias("_id_key"))


def accepted_rows(rows: DataFrame, verdicts: DataFrame, features=tuple(FEATURES)) -> DataFrame:
    """request, pos, id_client and the features of every row of the accepted requests. Rows join their request's
    verdict; a request with a large share of all rows is a skewed key that the planner splits."""
    kept = verdicts.where("accepted").select(F.col("request").alias("_request"), "_id_key")
    own = F.when(F.col("_id_key").isNull(), F.concat(F.lit(ID_PREFIX), (F.col("pos") + 1).cast("string"))).otherwise(F.try_element_at("_ids", "_id_key"))
    return rows.join(kept, F.col("request") == F.col("_request")).select("request", "pos", own.alias("id_client"), *features)


def score_requests(bodies: DataFrame, art: Artifacts, null_policy: str = "scaled_zero") -> tuple:
    """(scored, verdicts) of ``bodies`` (request, body): scored has request, pos and the columns of ``score_batch``
    for all rows of the accepted requests; verdicts one row a request. Bodies are parsed once."""
    checkpoint_root(bodies.sparkSession)
    rows = parse_requests(bodies, art.features).checkpoint()
    verdicts = request_verdicts(rows, art.features)
    scored = score_rows(accepted_rows(rows, verdicts, art.features), art, null_policy, keep=["request", "pos"])
    return scored, verdicts.drop("_id_key")
