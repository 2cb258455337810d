"""One object over a store: imports, search, analytics, exports, maintenance."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import registry
from .operators import compare, export, measures, pivot, prices, risk, rollups, search, series
from .plans import compiler
from .plans.query import Query
from .sources import gold as gold_tables
from .sources import ingest, snapshots, token_index
from .storage import read_text, separate_projections, write_text

#: What each scope of analytics consists of, besides overview and months.
SCOPES = {
    "companies": ("recipients", "senders", "companies"),
    "products": ("product_codes", "trademarks", "product_groups"),
    "countries": ("origin_countries", "dispatch_countries", "trade_countries"),
    "prices": (),
    None: (),
}
MOST_GROUPS = 1000


class Engine:
    """`where` is a folder of any store Spark writes: gold rows, log and rollups live in it."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        registry.register_functions(spark)

    @property
    def now(self) -> snapshots.Snapshot:
        """What readers see now; a frame made of it stays as it is, whatever is imported later."""
        return snapshots.current(self.spark, self.where)

    @property
    def gold(self) -> DataFrame:
        return ingest.gold_table(self.spark, self.where)

    def gold_for(self, q: Query) -> DataFrame:
        """Gold rows in the files that can have hits: those with all tokens and values of extra columns that the query asks for."""
        now = self.now
        files = token_index.files(self.spark, self.where, now.leaves, compiler.needed_terms(q), compiler.needed_ranges(q))
        return snapshots.rows(self.spark, self.where, now, files=files)

    def rows(self, q: Query) -> DataFrame:
        return compiler.apply(self.gold_for(q), q)

    # Imports

    def preview(self, path: str) -> list[ingest.Preview]:
        return ingest.preview(self.spark, path)

    def ingest(self, path: str, options: ingest.ImportOptions | None = None, profiles: dict | None = None) -> dict:
        return ingest.import_file(self.spark, path, self.where, options, profiles)

    def save_profile(self, name: str, headers: Sequence[str], meanings: dict[int, str | None]) -> None:
        """Meanings for all later imports of this layout."""
        ingest.save_profile(self.spark, self.where, name, list(headers), meanings)

    def schemas(self) -> DataFrame:
        """Sources by schema, with the currency that their values give evidence for."""
        return self.log().select("schema_id", "name", "rows").join(gold_tables.detect_currency(self.gold).select("schema_id", "currency"), "schema_id", "left")

    def log(self) -> DataFrame:
        """A row for each imported source."""
        return self._listed(self.now.log, snapshots.LOG)

    def edits(self) -> DataFrame:
        """Meanings and fixed values by schema and version; imports obey them."""
        return self._listed(self.now.edits, snapshots.EDITS)

    def _listed(self, entries: Sequence[dict], columns: str) -> DataFrame:
        names = [c.split()[0] for c in columns.split(", ")]
        return self.spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], columns)

    def fields(self, schema_id: int | None = None) -> list[str]:
        """All fields that pages and exports can have: the common ones, and the extra columns of one schema or of all."""
        rows = self.gold if schema_id is None else self.gold.filter(F.col("schema_id") == schema_id)
        return [*search.FIELDS, *[f"extra:{r['header']}" for r in search.extra_headers(rows).orderBy("key").collect()]]

    def assign(self, schema_id: int, header: str, meaning: str) -> None:
        """Takes an extra column of a schema for a meaning, for its rows and those of later imports."""
        self._edit(schema_id, {"header": header, "meaning": gold_tables.checked_meaning(meaning)})

    def fix(self, schema_id: int, currency: str | None = None, weight_unit: str | None = None) -> None:
        """Gives a schema's rows, and those of later imports, a currency or weight unit where they name none."""
        ingest.ImportOptions(currency=currency, weight_unit=weight_unit)  # checks them
        self._edit(schema_id, {"currency": currency, "weight_unit": weight_unit})

    def _edit(self, schema_id: int, edit: dict) -> None:
        """Rewrites the leaves of one schema; they and the edit's new version become visible together."""
        now = self.now
        own = now.of_schema(schema_id)
        if not own:
            raise ValueError(f"no such schema: {schema_id}")
        version = sum(e["schema_id"] == schema_id for e in now.edits) + 1
        with separate_projections(self.spark):
            base = snapshots.rows(self.spark, self.where, now, own).drop(*gold_tables.derived_columns())
            self._replace(now, own, gold_tables.with_keys(gold_tables.edited(base, [edit])), edits=(*now.edits, {"schema_id": schema_id, "version": version, **edit}))

    # Search

    def search(self, q: Query, fields: Sequence[str] = search.FIELDS, sort: search.Sort | None = None, limit: int = search.PAGE, offset: int = 0) -> DataFrame:
        return search.page(self.gold_for(q), q, fields, sort, limit, offset)

    def count(self, q: Query) -> int:
        return search.count(self.gold_for(q), q).first()["rows"]

    def record(self, id_: int) -> Row | None:
        return search.record(self.gold, id_)

    def snapshot(self) -> int:
        """The greatest id now; a query with it sees no later imports."""
        return self.gold.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    # Analytics

    def analytics(self, q: Query, scope: str | None = None, limit: int = 10, hs_level: int = 4, full: bool = False) -> dict[str, DataFrame]:
        """Overview, measures and months, and the sections of one scope or of all; nothing but the counts of prices runs until a part is asked for."""
        rows, limit = self.rows(q), max(1, min(limit, MOST_GROUPS))
        out = {
            "overview": measures.overview(rows), "currencies": measures.currency_totals(rows), "net_weights": measures.weight_totals(rows), "gross_weights": measures.weight_totals(rows, "gross"),
            "exclusions": measures.exclusions(rows), "months": series.months(rows),
        }
        kinds = [k for s in SCOPES.values() for k in s] if full else SCOPES[scope]
        out |= {k: series.section(rows, k, limit, hs_level) for k in kinds}
        return out | ({"prices": prices.metrics(rows), "price_cohorts": prices.cohorts(rows)} if full or scope == "prices" else {})

    def previews(self, q: Query, limit: int = 5) -> dict[str, DataFrame]:
        """The first section of each scope."""
        rows = self.rows(q)
        return {"basis": measures.basis(rows)} | {s: series.section(rows, kinds[0], limit) for s, kinds in SCOPES.items() if kinds}

    def pivot(self, q: Query, row: str, column: str, metric: str = "value", **limits) -> tuple[DataFrame, DataFrame]:
        """The long table and its one honest unit."""
        rows = self.rows(q)
        return pivot.pivot(rows, row, column, metric, **limits), pivot.unit(rows, metric)

    def compare(self, left: Query, right: Query) -> DataFrame:
        return compare.compare(self.rows(left), self.rows(right))

    def company_profile(self, company: str, limit: int = 10) -> dict[str, DataFrame]:
        return compare.company_profile(self.gold, company, limit)

    def price_risk(self, q: Query, threshold: float = risk.THRESHOLD, samples: int = risk.SAMPLES, limit: int = risk.LIMIT) -> dict[str, DataFrame]:
        rows = self.rows(q)
        screen = risk.screened(rows, threshold, samples)
        return {
            "summary": risk.summary(rows, screen=screen), "rows": risk.rows_at_risk(rows, limit=limit, screen=screen), "currencies": risk.by_currency(rows, screen=screen),
            "companies": risk.by_company(rows, screen=screen), "confidence": risk.by_confidence(rows, screen=screen),
        }

    def version(self) -> int:
        """Of the store: another after each import or rewrite."""
        return self.now.number

    def build_rollups(self) -> None:
        """Rollup parts of all leaves; from now on imports and rewrites make those of theirs."""
        now = self.now
        if not now.rolled:
            for leaf in now.leaves:
                rollups.write_parts(snapshots.rows(self.spark, self.where, now, [leaf]), f"{self.where}/{snapshots.ROLLUPS}", leaf)
            rollups.validate(self.gold, self.rollup("overview", now))
            snapshots.commit(self.spark, self.where, now, rolled=True)

    def rollup(self, name: str, now: snapshots.Snapshot | None = None) -> DataFrame:
        """One of rollups.MERGED, put together from the parts of all leaves."""
        now = now or self.now
        return rollups.MERGED[name]({p: snapshots.beside(self.spark, self.where, f"{snapshots.ROLLUPS}/{p}", now.leaves) for p in rollups.NEEDED[name]})

    def overview_row(self, q: Query) -> tuple[DataFrame, str]:
        """Key numbers of a query from the rollups where there are any and they are safe, and where they came from."""
        now = self.now
        if now.rolled and now.leaves and rollups.eligible(q):
            own = rollups.chosen(self.rollup("overview", now), q)
            if rollups.is_safe(own):
                return own, "rollups"
        return measures.overview(self.rows(q)), "rows"

    def sql(self, query: str) -> DataFrame:
        """A query over the views `records` (gold rows) and `imports` (the log), for diagnosis; all values as texts."""
        if query.split(None, 1)[0].lower() not in ("select", "with", "from", "values"):
            raise ValueError("only queries")
        self.gold.createOrReplaceTempView("records")
        self.log().createOrReplaceTempView("imports")
        found = self.spark.sql(query)
        return found.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in found.columns])

    # Saved queries

    def save_query(self, name: str, q: Query | None) -> None:
        """Keeps a query under a name; None removes it."""
        known = self._saved()
        known.pop(name, None)
        if q is not None:
            known[name] = q.to_json()
        write_text(self.spark, f"{self.where}/queries.json", json.dumps(known, ensure_ascii=False))

    def saved_query(self, name: str) -> Query:
        return Query.from_json(self._saved()[name])

    def _saved(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.where}/queries.json") or "{}")

    # Exports and maintenance

    def export_csv(self, q: Query, fields: Sequence[str], path: str, sort: search.Sort | None = None) -> int:
        return export.write_csv_file(self.gold, q, fields, path, sort)

    def export_xlsx(self, q: Query, fields: Sequence[str], path: str, sort: search.Sort | None = None) -> int:
        return export.write_xlsx(self.gold, q, fields, path, sort)

    def stats(self) -> DataFrame:
        """Rows, duplicates and sources of each schema."""
        return self.gold.groupBy("schema_id").agg(F.count("*").alias("rows"), F.count_if(~F.col("is_canonical")).alias("duplicates"), F.count_distinct("source_file").alias("sources"))

    def stored_bytes(self) -> dict[str, int]:
        fs, path = snapshots.hadoop(self.spark, self.where)
        return {name: fs.getContentSummary(path(f"{self.where}/{name}")).getLength() for name in (snapshots.GOLD, snapshots.ROLLUPS, snapshots.TOKENS, snapshots.RANGES) if self._exists(name)}

    def compact(self, files: int) -> None:
        """Rewrites the gold table as one leaf a schema, in about so many files."""
        now = self.now
        last = max(snapshots.parts_of(leaf)[0] for leaf in now.leaves)
        rows = self.gold.withColumn("part", F.lit(last)).repartition(files, "schema_id", F.pmod(F.xxhash64("id"), F.lit(files)))
        self._replace(now, now.leaves, rows, [f"part={last}/schema_id={snapshots.parts_of(leaf)[1]}/g" for leaf in now.leaves])

    def remark(self) -> None:
        """Marks duplicates anew, where rows were deleted and duplicates may have lost their canonical row."""
        now = self.now
        self._replace(now, now.leaves, gold_tables.remarked(snapshots.rows(self.spark, self.where, now)))

    def backfill(self) -> None:
        """Derives months, labels, keys, tokens, years and kilograms anew from the stored columns, as an older store may lack or differ in them; part by part."""
        for number in sorted({snapshots.parts_of(leaf)[0] for leaf in self.now.leaves}):
            now = self.now
            own = [leaf for leaf in now.leaves if snapshots.parts_of(leaf)[0] == number]
            with separate_projections(self.spark):
                self._replace(now, own, gold_tables.with_keys(snapshots.rows(self.spark, self.where, now, own).drop(*gold_tables.derived_columns())))

    def _replace(self, now: snapshots.Snapshot, old: Sequence[str], rows: DataFrame, candidates: Sequence[str] | None = None, **changes) -> None:
        """New leaves in the place of old ones, with what lies beside them; nothing is seen of it before the snapshot."""
        new = snapshots.write_leaves(self.spark, self.where, rows, candidates or old)
        for leaf in new:
            ingest.beside_leaf(self.spark, self.where, leaf, now.rolled)
        snapshots.commit(self.spark, self.where, now, leaves=(*[leaf for leaf in now.leaves if leaf not in set(old)], *new), **changes)

    def vacuum(self) -> int:
        """Removes the folders of older snapshots and of writers that stopped, while no other is at work."""
        return snapshots.vacuum(self.spark, self.where)

    def clear(self) -> None:
        """An empty store, for good: its next snapshot names nothing, then the folders go."""
        now = self.now
        snapshots.commit(self.spark, self.where, now, leaves=(), log=(), edits=(), rolled=False)
        snapshots.vacuum(self.spark, self.where, 1)

    def _exists(self, name: str) -> bool:
        fs, path = snapshots.hadoop(self.spark, self.where)
        return fs.exists(path(f"{self.where}/{name}"))
