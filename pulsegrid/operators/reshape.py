"""JSON, map, key and wide/long reshaping."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.schema import CANDIDATES, CLASS_NAMES, COUNTS_MAP


def parse_json(col, schema) -> Column:
    """Parsed JSON; null or empty text gives null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(F.when(c != "", c), schema)


def json_fields(df: DataFrame, keys, col) -> DataFrame:
    """One row (keys, field, kind, number, text) per field of a JSON object of any keys.

    The text is parsed once, to a variant. ``kind`` is number, text, boolean, null, array or object. ``number`` is the
    value of a number or of a text that reads as one, else null; ``text`` is the value of a text, else null.
    Null, empty and malformed texts and those that hold no object have no fields; what follows the first whole value is not read.
    """
    c = F.col(col) if isinstance(col, str) else col
    fields = F.try_variant_get(F.try_parse_json(F.when(c != "", c)), "$", "map<string,variant>")
    rows = df.select(*keys, F.explode(fields).alias("field", "_v")).withColumn("_s", F.schema_of_variant("_v"))
    kind = F.expr("""case when _s is null or _s = 'VOID' then 'null' when _s = 'STRING' then 'text' when _s = 'BOOLEAN' then 'boolean'
        when startswith(_s, 'ARRAY') then 'array' when startswith(_s, 'OBJECT') then 'object' else 'number' end""")
    return rows.withColumn("kind", kind).select(
        *keys, "field", "kind", F.when(F.col("kind").isin("number", "text"), F.try_variant_get("_v", "$", "double")).alias("number"),
        F.when(F.col("kind") == "text", F.try_variant_get("_v", "$", "string")).alias("text"))


def counts_long(df: DataFrame, keys, splits: dict) -> DataFrame:
    """Count-map JSON columns (split label -> column) to (keys, split, class, count)."""
    items = F.array(*[
        F.struct(F.lit(label).alias("split"), parse_json(col, COUNTS_MAP).alias("m"))
        for label, col in splits.items()])
    return df.select(*keys, F.explode(items).alias("_i")).select(
        *keys, "_i.split", F.explode("_i.m").alias("class", "count"))


def multipliers_long(df: DataFrame, keys, col="multiplier") -> DataFrame:
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return df.select(*keys, F.posexplode(col).alias("_i", "multiplier")).select(
        *keys, F.element_at(names, F.col("_i") + 1).alias("class"), "multiplier")


def candidate_rows(df: DataFrame, keys, col="validation_table") -> DataFrame:
    """One row per candidate of a JSON candidate list; absent fields stay null."""
    return df.select(*keys, F.explode(parse_json(col, CANDIDATES)).alias("c")).select(
        *keys, "c.alpha", "c.decoder", "c.val_macro_f1_4", "c.val_accuracy", "c.val_F1_S", "c.val_F1_F")


def to_long(df: DataFrame, keys, columns, name="name", value="value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def to_wide(df: DataFrame, keys, name, value, values) -> DataFrame:
    """Long to wide over a known value list, so no extra pass looks for the values."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(name) == v, F.col(value))).alias(v) for v in values])


def split_name(df: DataFrame, name, into, sep="_") -> DataFrame:
    parts = F.split(name, sep)
    return df.select(*[c for c in df.columns if c != name],
                     *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(into)])


def split_key(df: DataFrame, key, into, sep="|") -> DataFrame:
    """Split composite keys; keys with another number of parts are ignored."""
    parts = F.split(key, "[|]" if sep == "|" else sep)
    rows = df.withColumn("_p", parts).where(F.size("_p") == len(into))
    return rows.select(*df.columns, *[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(into)])


def composite_key(*cols) -> Column:
    return F.concat_ws("|", *cols)


def recode(col, mapping: dict) -> Column:
    """Mapped label, or the value itself where the map has none."""
    c = F.col(col) if isinstance(col, str) else col
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)


def order_in(col, order) -> Column:
    """Position of a value in an explicit order, for sorting by category."""
    return F.array_position(F.array(*[F.lit(o) for o in order]), F.col(col) if isinstance(col, str) else col)


def clean_method(col) -> Column:
    return F.regexp_replace(col, "_raw|raw_", "")


def percent(col, digits=2) -> Column:
    return F.round(F.col(col) * 100.0, digits)


def matching_columns(df: DataFrame, pattern: str):
    return [c for c in df.columns if c in set(df.select(df.colRegex(f"`{pattern}`")).columns)]


def paired_deltas(df: DataFrame, metrics, raw="raw_", delta="delta_") -> DataFrame:
    return df.select("*", *[(F.col(m) - F.col(raw + m)).alias(delta + m) for m in metrics])


def alias_columns(df: DataFrame, aliases: dict, **literals) -> DataFrame:
    """Copy columns under published names, skip absent ones, add literal columns."""
    have = set(df.columns)
    return df.select("*", *[F.col(s).alias(a) for a, s in aliases.items() if s in have],
                     *[F.lit(v).alias(k) for k, v in literals.items()])


def drop_empty(df: DataFrame, columns, positive=()) -> DataFrame:
    """Rows whose ``columns`` are neither null nor NaN and whose ``positive`` are > 0."""
    out = df
    for c in columns:
        out = out.where(F.col(c).isNotNull())
        if dict(df.dtypes)[c] in ("double", "float"):
            out = out.where(~F.isnan(c))
    for c in positive:
        out = out.where(F.col(c) > 0)
    return out


def subset(df: DataFrame, datasets=(), families=(), methods=(), seeds=(), contains=None,
           config="config") -> DataFrame:
    """Run filters; an empty list means all, methods match without case."""
    out = df
    for c, wanted in (("dataset", datasets), ("family", families), ("seed", seeds)):
        if wanted:
            out = out.where(F.col(c).isin(list(wanted)))
    if methods:
        out = out.where(F.lower("method").isin([m.lower() for m in methods]))
    if contains:
        out = out.where(F.col(config).contains(contains))
    return out
