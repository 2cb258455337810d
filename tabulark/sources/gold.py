"""Gold tables: every number, key and label derived once, duplicates marked, payload on every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, keys, numbers, text
from ..schema import COUNTRIES, EXTRA, GROUPED_NUMBERS, LABELS, PRICES, SEARCHED, SEMANTICS, TableShape


def first_text(options: Sequence[Column]) -> Column:
    """The first that isn't empty, else empty."""
    return F.coalesce(*[F.nullif(text.blank(o), F.lit("")) for o in options], F.lit("")) if options else F.lit("")


class SemanticResolver:
    """Column expressions for meanings, from the columns of a raw table that carry them.

    A meaning is resolved from all columns that carry it, in their order; empty texts
    and numbers that aren't any are passed over.
    """

    def __init__(self, raw: DataFrame, shape: TableShape | None = None):
        self.names, self.shape = set(raw.columns), shape

    def raw(self, semantic: str) -> list[Column]:
        if self.shape is not None and (own := self.shape.sources(semantic)):
            return [F.col(c.id) if c.id in self.names else text.extra_value(F.col("extra"), c.header) for c in own]
        return [F.col(semantic)] if semantic in self.names else []

    def text(self, semantic: str) -> Column:
        return first_text(self.raw(semantic))

    def label(self, semantic: str) -> Column:
        return text.label_value(self.text(semantic))

    def number(self, semantic: str) -> Column:
        found = [numbers.num_value(c, semantic in GROUPED_NUMBERS) for c in self.raw(semantic)]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    def country(self, semantic: str) -> Column:
        return keys.country_key(self.text(semantic))

    def month(self) -> Column:
        return dates.month_key(self.text("date"))

    def currency(self) -> Column:
        """Mapped column, else the file's fixed one, else what all value headers say."""
        fixed = self.shape.fixed_currency if self.shape else None
        hint = None if self.raw("currency") or not self.shape else keys.common_hint([keys.currency_hint(h) for h in self.shape.headers("value")])
        return first_text([*self.raw("currency"), *[F.lit(x) for x in (fixed, hint) if x]])

    def unit(self) -> Column:
        fixed = self.shape.fixed_weight_unit if self.shape else None
        headers = self.shape.headers("net_weight") + self.shape.headers("gross_weight") if self.shape else []
        hint = None if self.raw("weight_unit") else keys.common_hint([keys.unit_hint(h) for h in headers])
        return first_text([*self.raw("weight_unit"), *[F.lit(x) for x in (fixed, hint) if x]])


def to_gold(raw: DataFrame, shape: TableShape | None = None, edits: Sequence[dict] = ()) -> DataFrame:
    """Gold rows of raw ones (id, schema_id, source_file, extra and meaning columns).

    Numbers come before the join that marks duplicates, keys and labels after it, so that
    each side's generated code stays small enough to be compiled.  Raw rows that are marked already stay so.  edits: those of the rows' schema; contents are compared as they were before any.
    """
    rows = with_numbers(raw, shape)
    return with_keys(edited(rows if set(MARKS) <= set(raw.columns) else mark_duplicates(rows), edits))


#: What marking adds to a row.
MARKS = ("is_canonical", "first_file")


def content_hash(raw: DataFrame, besides: str = "") -> Column:
    """The hash of all that raw rows say, besides where they come from."""
    extra = F.col("extra") if "extra" in raw.columns else F.array().cast(EXTRA)
    return text.row_hash([text.blank(F.col(c)) for c in raw.columns if c not in ("id", "schema_id", "source_file", "extra", "year", besides, *MARKS)], extra)


def marked_raw(raw: DataFrame, within: str) -> DataFrame:
    """Raw rows with their duplicates marked; within: a column that equal contents share and of which each value has few rows.

    Rows that are dealt out by it aren't shuffled again, so only the first row's id and file meet the rest.
    """
    same = Window.partitionBy(within, "schema_id", "row_hash")
    firsts = raw.withColumn("row_hash", content_hash(raw, within)).withColumn("first", F.min(F.struct("id", "source_file")).over(same))
    return firsts.withColumns({"is_canonical": F.col("first.id") == F.col("id"), "first_file": F.col("first.source_file")}).drop("first", "row_hash")


def with_numbers(raw: DataFrame, shape: TableShape | None = None) -> DataFrame:
    """Resolved texts, parsed numbers and the hash of each row's content."""
    r = SemanticResolver(raw, shape)
    extra = F.col("extra") if "extra" in raw.columns else F.array().cast(EXTRA)
    return raw.select(
        "id", "schema_id", "source_file", extra.alias("extra"),
        dates.normalize_date(r.text("date")).alias("date"),
        *[r.text(s).alias(s) for s in SEMANTICS if s not in ("date", "value", "quantity", "net_weight", "gross_weight", "currency", "weight_unit")],
        *[r.number(s).alias(n) for s, n in (("value", "value"), ("quantity", "quantity"), ("net_weight", "net"), ("gross_weight", "gross"))],
        *[(numbers.num_value(F.col(p)) if p in raw.columns else F.lit(None).cast("double")).alias(p) for p in PRICES],
        r.currency().alias("currency"), r.unit().alias("weight_unit"),
        content_hash(raw).alias("row_hash"), *[c for c in MARKS if c in raw.columns],
    )


def with_keys(base: DataFrame) -> DataFrame:
    """Months, labels, keys, tokens, years and kilograms from resolved columns."""
    keyed = base.select(
        "*",
        dates.month_key(F.col("date")).alias("month"),
        *[text.label_value(F.col(c)).alias(f"{c}_label") for c in LABELS],
        *[keys.country_key(F.col(c)).alias(f"{c}_key") for c in (*COUNTRIES, "country")],
        keys.currency_key(F.col("currency")).alias("currency_key"),
        keys.unit_key(F.col("weight_unit")).alias("unit_key"),
        text.search_tokens(*[F.col(c) for c in SEARCHED], text.extra_values_text(F.col("extra"))).alias("tokens"),
    )
    factor = keys.unit_factor(F.col("unit_key"))
    return keyed.select(
        "*",
        F.coalesce(dates.extract_year(F.col("date")), F.substring("month", 1, 4).try_cast("int")).alias("year"),
        (F.col("net") * factor).alias("net_kg"),
        (F.col("gross") * factor).alias("gross_kg"),
    )


def derived_columns() -> list[str]:
    """What with_keys adds."""
    return ["month", *[f"{c}_label" for c in LABELS], *[f"{c}_key" for c in (*COUNTRIES, "country")], "currency_key", "unit_key", "tokens", "year", "net_kg", "gross_kg"]


def mark_duplicates(rows: DataFrame) -> DataFrame:
    """is_canonical: the first row (by id) of each content in a schema; first_file: that row's file.

    The first row's id and file come from one map-side combined aggregate and go back by a
    join that Spark can split where contents are very frequent.
    """
    firsts = rows.groupBy("schema_id", "row_hash").agg(F.min(F.struct("id", "source_file")).alias("first"))
    return rows.join(firsts, ["schema_id", "row_hash"]).select(
        "*", (F.col("first.id") == F.col("id")).alias("is_canonical"), F.col("first.source_file").alias("first_file")
    ).drop("first")


#: Gold columns of meanings that are kept as numbers.
NUMBER_COLUMNS = {"value": "value", "quantity": "quantity", "net_weight": "net", "gross_weight": "gross"}


def edited(base: DataFrame, edits: Sequence[dict]) -> DataFrame:
    """Rows of one schema without derived columns, after edits in their order.

    An edit takes an extra column for a meaning (header, meaning), or gives rows a currency or weight unit where they name none.
    """
    for e in edits:
        if e.get("meaning"):
            meaning, value = e["meaning"], text.extra_value(F.col("extra"), e["header"])
            new = numbers.num_value(value, meaning in GROUPED_NUMBERS) if meaning in NUMBER_COLUMNS else dates.normalize_date(value) if meaning == "date" else value
            rest = F.filter("extra", lambda p: text.text_key(p["header"]) != text.text_key(F.lit(e["header"])))  # noqa: B023
            base = base.withColumns({NUMBER_COLUMNS.get(meaning, meaning): new, "extra": rest})
        for c in ("currency", "weight_unit"):
            if e.get(c):
                base = base.withColumn(c, F.when(text.trimmed(text.blank(F.col(c))) == "", F.lit(e[c])).otherwise(F.col(c)))
    return base


def assigned(gold: DataFrame, schema_id: int, header: str, meaning: str) -> DataFrame:
    """Gold rows where an extra column of a schema has become the column of a meaning; their keys are derived again.

    Rows keep their identity: a content is the same whatever its columns are taken for.
    """
    return _rederived(gold, schema_id, {"header": header, "meaning": checked_meaning(meaning)})


def fixed(gold: DataFrame, schema_id: int, currency: str | None = None, weight_unit: str | None = None) -> DataFrame:
    """Gold rows where all of a schema have a currency or weight unit that they don't name themselves."""
    return _rederived(gold, schema_id, {"currency": currency, "weight_unit": weight_unit})


def _rederived(gold: DataFrame, schema_id: int, edit: dict) -> DataFrame:
    own = F.col("schema_id") == schema_id
    changed = with_keys(edited(gold.filter(own).drop(*derived_columns()), [edit]))
    return gold.filter(~own).unionByName(changed.select(*gold.columns))


def checked_meaning(meaning: str) -> str:
    if meaning not in SEMANTICS:
        raise ValueError(f"unknown meaning: {meaning}")
    return meaning


def orphans(gold: DataFrame) -> DataFrame:
    """Duplicates whose content no canonical row has any more, as after rows were deleted.

    A content has one canonical row; hashes are compared as bytes, half as long as their texts.
    """
    content = F.unhex("row_hash").alias("content")
    owners = gold.filter("is_canonical").select("schema_id", content)
    return gold.filter(~F.col("is_canonical")).select("*", content).join(owners, ["schema_id", "content"], "left_anti").select(*gold.columns)


def remarked(gold: DataFrame) -> DataFrame:
    """Gold rows with their duplicates marked anew: each content's first row that is left becomes canonical."""
    return mark_duplicates(gold.drop("is_canonical", "first_file"))


#: So many row hashes of an import at most (40 bytes each) are sent to where the history is read; more are shuffled.
SENT_HASHES = 1_000_000


def mark_against(rows: DataFrame, history: DataFrame, n: int | None = None) -> DataFrame:
    """Gold rows that come after the canonical rows of an existing gold table: known contents are duplicates of those.

    n: the number of rows, where it is known to be small the history is not shuffled.
    """
    wanted = rows.select("schema_id", "row_hash").distinct()
    known = history.filter("is_canonical").select("schema_id", "row_hash", F.struct("id", "source_file").alias("old"))
    if n is not None and n <= SENT_HASHES:
        known = known.join(F.broadcast(wanted), ["schema_id", "row_hash"], "left_semi")
    marked = rows.join(known, ["schema_id", "row_hash"], "left")
    return marked.withColumns({
        "is_canonical": F.col("is_canonical") & F.col("old").isNull(),
        "first_file": F.coalesce("old.source_file", "first_file"),
    }).drop("old")


def detect_currency(gold: DataFrame, least: int = 30, agreement: float = 0.95, tolerance: float = 0.02) -> DataFrame:
    """(schema_id, comparable, agreement, currency): USD where values agree with reference price x weight.

    Comparable rows have a positive value and reference price and a positive weight; one
    agrees when either weight explains the value within the tolerance.
    """
    v, r = F.col("value"), F.col("rfv")
    near = lambda w: F.coalesce((F.col(w) > 0) & (F.abs(v - r * F.col(w)) <= tolerance * v), F.lit(False))
    comparable = (v > 0) & (r > 0) & ((F.col("net") > 0) | (F.col("gross") > 0))
    per = lambda w: F.count_if(near(w)) / F.nullif(F.count("*"), F.lit(0))
    found = gold.filter(comparable).groupBy("schema_id").agg(F.count("*").alias("comparable"), F.greatest(per("net"), per("gross")).alias("agreement"))
    good = (F.col("comparable") >= least) & (F.col("agreement") >= agreement)
    return found.select("*", F.when(good, "USD").alias("currency"))
