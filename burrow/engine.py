"""The engine: an index of entries and the questions asked of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow import sinks
from burrow.config import EngineConfig
from burrow.operators import journal as J
from burrow.operators import ngrams, results, tree
from burrow.plans.compile import predicate
from burrow.plans.spec import QuerySpec, parse
from burrow.store import Tables


@dataclass
class Engine:
    """``entries`` as of ``tree.build``; ``posting`` if names are indexed by grams, of the entries before ``built_at``."""

    entries: DataFrame
    config: EngineConfig = field(default_factory=EngineConfig)
    posting: DataFrame | None = None
    built_at: DataFrame | None = None

    @classmethod
    def build(cls, raw: DataFrame, config: EngineConfig | None = None, with_grams: bool = False) -> Engine:
        """Builds the index once: searches read what is written here, not the sources."""
        entries = stored(tree.build(raw), "drive")
        found = cls(entries, config or EngineConfig())
        return found.attach_grams() if with_grams else found

    def attach_grams(self) -> Engine:
        """With an index of all present entries, and its watermark."""
        posting = stored(ngrams.clustered(ngrams.postings(self.entries)), "drive")
        return replace(self, posting=posting, built_at=stored(ngrams.built_at(self.entries)))

    def clear_grams(self) -> Engine:
        return replace(self, posting=None, built_at=None)

    def append(self, raw: DataFrame) -> Engine:
        """With more entries after the present ones, which keep their positions. The gram index stays as it is: what is new is
        read as its tail until ``attach_grams`` is called.
        """
        columns = [c for c in raw.columns if c != "is_deleted"]
        old = self.entries.select(*columns, "is_deleted", F.lit(0).alias("_late"), F.col("entry_idx").alias("_place"))
        new = raw.select(*columns, F.lit(False).alias("is_deleted"), F.lit(1).alias("_late"), F.lit(0).cast("long").alias("_place"))
        built = tree.build(old.unionByName(new), "_late", "_place", "mft_ref", "name").drop("_late", "_place")
        return replace(self, entries=stored(built.select(*self.entries.columns), "drive"))

    def with_config(self, **changes) -> Engine:
        return replace(self, config=replace(self.config, **changes))

    def parse(self, query: str) -> QuerySpec:
        return parse(query, self.config)

    def hits(self, query: str) -> DataFrame:
        """All matching entries, not capped or sorted."""
        spec = self.parse(query)
        if not spec.selects:
            return self.entries.limit(0)
        return ngrams.pruned(self.entries, self.posting, spec, self.built_at).where(predicate(spec, self.config))

    def search(self, query: str) -> DataFrame:
        """The shown rows: capped in drive order first, then sorted."""
        capped = results.cap(self.hits(query), self.config.max_results)
        return results.project(results.sort(capped, self.config.sort_column, self.config.sort_ascending), self.config.time_zone)

    def probe(self, query: str, most: int = 50) -> DataFrame:
        """The first hits in drive order, as a console shows them."""
        return results.cap(self.hits(query), most)

    def restored(self) -> DataFrame | None:
        """The last search again, if the settings ask for it."""
        return self.search(self.config.last_search) if self.config.restore_last_search and self.config.last_search else None

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the view ``entries``."""
        self.entries.createOrReplaceTempView("entries")
        return self.entries.sparkSession.sql(text)

    def summary(self) -> DataFrame:
        return results.drive_counts(self.entries)

    def export_csv(self, query: str, folder: str) -> None:
        sinks.export_csv(self.search(query), folder, self.config.language)

    def apply_journal(self, journal: DataFrame, apply_moves: bool = False) -> Engine:
        raw = J.apply(self.entries, journal, apply_moves)
        entries = stored(tree.build(raw, "mft_ref", "is_deleted", "name"), "drive")
        after = replace(self, entries=entries, posting=None, built_at=None)
        return after.attach_grams() if self.posting is not None else after


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows as written to a new Parquet folder in the shared one."""
    return Tables(df.sparkSession).add(df, *by)


_built: dict[tuple[str, str], Engine] = {}


def fixture_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over the test tables' namespace, built once a session and folder."""
    from burrow.sources import fixtures

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Engine.build(fixtures.raw_entries(spark, sf_dir), with_grams=True)
    return _built[key]
