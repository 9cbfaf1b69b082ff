"""From names and registry documents to queue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tarsift.functions.timestamps import parse_timestamp

c, lit = F.col, F.lit
KEYS = ["name", "version"]

RECORD = ["name", "version", "tarball", "integrity", "shasum", "published_at", "meta_head"]


def latest_versions(documents: DataFrame) -> DataFrame:
    """One queue record per document: its latest version, if that has an archive."""
    latest = F.nullif(F.try_element_at("dist_tags", lit("latest")), lit(""))
    base = documents.withColumn("version", latest).filter(c("version").isNotNull())
    dist = F.try_element_at(c("versions"), c("version"))["dist"]
    blank = lambda field: F.nullif(dist[field], lit(""))
    records = base.select(
        "name",
        "version",
        blank("tarball").alias("tarball"),
        blank("integrity").alias("integrity"),
        blank("shasum").alias("shasum"),
        F.nullif(F.try_element_at("time", c("version")), lit("")).alias("published_at"),
        F.nullif(F.try_element_at("time", lit("modified")), lit("")).alias("meta_head"),
    )
    return records.filter(c("tarball").isNotNull())


def skip_analyzed(records: DataFrame, versions: DataFrame) -> DataFrame:
    done = versions.filter(c("status") == "analyzed").select(*KEYS)
    return records.join(done, KEYS, "left_anti")


def enrich(records: DataFrame, source: str, queued_at: Column | None = None) -> DataFrame:
    when = F.current_timestamp() if queued_at is None else queued_at
    return records.withColumns({"queued_at": when, "source": lit(source)})


def mark_fetched(records: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """Add the fetch time; a record that was never stamped as queued gets it now."""
    when = F.current_timestamp() if fetched_at is None else fetched_at
    return records.withColumns({"fetched_at": when, "queued_at": F.coalesce("queued_at", when)})


def build_queue(
    documents: DataFrame,
    versions: DataFrame | None = None,
    seeds: DataFrame | None = None,
    changes: DataFrame | None = None,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Queue records for the wanted names, each version once, with its ``origin``.

    Seeds win: with seeds given, only they count, and analysed versions are not skipped.
    Otherwise names come from the change feed first, then from the listing.
    """
    latest = latest_versions(documents)
    if seeds is not None:
        wanted = seeds.select("name", lit(0).alias("rank"))
    else:
        sources = [(changes, 1), (listing, 2)]
        frames = [df.select("name", lit(rank).alias("rank")) for df, rank in sources if df is not None]
        wanted = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    # A name may come many times; each task keeps its best source before the shuffle.
    best = wanted.groupBy("name").agg(F.min("rank").alias("rank"))
    records = latest.join(best, "name")
    if seeds is None and versions is not None:
        records = skip_analyzed(records, versions)
    origin = F.element_at(
        F.array(lit("seeds"), lit("changes"), lit("listing")), c("rank") + 1
    )
    return records.select(*RECORD, origin.alias("origin"))


def latest_activity(time: Column) -> Column:
    """The latest readable timestamp of a document's time map."""
    return F.array_max(F.transform(F.map_values(time), parse_timestamp))


def touched_since(documents: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Documents with activity in the last ``days``; those of unknown age are kept."""
    at = latest_activity(c("time"))
    return documents.filter(at.isNull() | (at >= as_of - F.make_dt_interval(lit(days))))


def next_page(listing: DataFrame, cursor: str | None, page: int, pages: int = 0) -> DataFrame:
    """Names after the cursor in order, at most ``pages`` pages; 0 pages is unbounded."""
    names = listing.select("name").distinct()
    if cursor is not None:
        names = names.filter(c("name") > cursor)
    return names.orderBy("name").limit(page * pages) if pages > 0 else names


def next_state(
    state: DataFrame, page_rows: DataFrame, page: int, pages: int, run_at: Column, queued: DataFrame
) -> DataFrame:
    """The resume state after a run, as a one-row table.

    The cursor is the last name read; a run that reached the end starts over (NULL).
    """
    tagged = (
        state.select(lit("state").alias("kind"), c("last_seq").alias("value"))
        .unionByName(page_rows.select(lit("read").alias("kind"), c("name").alias("value")))
        .unionByName(queued.select(lit("queued").alias("kind"), c("name").alias("value")))
    )
    of = lambda kind: c("kind") == kind
    totals = tagged.agg(
        F.max(F.when(of("state"), c("value"))).alias("last_seq"),
        F.max(F.when(of("read"), c("value"))).alias("last"),
        F.count_if(of("read")).alias("n"),
        F.count_if(of("queued")).alias("last_processed"),
    )
    ended = (c("n") < page * pages) if pages > 0 else lit(True)
    return totals.select(
        "last_seq",
        F.when(~ended, c("last")).alias("last_startkey"),
        run_at.alias("last_run"),
        "last_processed",
        c("last_processed").alias("last_new"),
    )


def resume_cursor(state: DataFrame, override: str | None = None) -> str | None:
    """Where to go on: the stored cursor, or the start when a run is overridden."""
    if override is not None and override.strip().lower() not in ("0", "null", "undefined", ""):
        return None
    row = state.select("last_startkey").first()
    return row["last_startkey"] if row else None


def upsert_queued(versions: DataFrame, records: DataFrame) -> DataFrame:
    """Versions with the records merged in: new ones are 'queued'; known ones get the
    archive's data refreshed and keep their status."""
    facts = F.struct("tarball", "integrity", "shasum", "published_at")
    # A version may be queued many times; an aggregate keeps one record per task first. The
    # record queued last counts; of records queued together the greater, which a missing
    # value never is.
    queued_at = c("queued_at").cast("timestamp") if "queued_at" in records.columns else lit(None)
    once = records.groupBy(*KEYS).agg(F.max_by(facts, F.struct(queued_at, facts)).alias("r"))
    fresh = once.select(
        *KEYS,
        c("r.tarball").alias("new_tarball_url"),
        c("r.integrity").alias("new_integrity"),
        c("r.shasum").alias("new_shasum"),
        parse_timestamp(c("r.published_at")).alias("new_published_at"),
        lit(True).alias("is_fresh"),
    )
    merged = versions.join(fresh, KEYS, "full_outer")
    refreshed = lambda col: F.when(c("is_fresh"), c(f"new_{col}")).otherwise(c(col)).alias(col)
    kept = [col for col in versions.columns if col not in
            (*KEYS, "tarball_url", "integrity", "shasum", "published_at", "status")]
    return merged.select(
        *KEYS,
        *[refreshed(col) for col in ("tarball_url", "integrity", "shasum", "published_at")],
        F.coalesce("status", lit("queued")).alias("status"),
        *kept,
    )


def run_counters(queued: DataFrame) -> DataFrame:
    """The counters of a run as a table: a second pass over what was queued."""
    return queued.agg(
        F.count("*").alias("last_processed"), F.count("*").alias("last_new")
    )


def observed(queued: DataFrame, new: Column | None = None) -> tuple[DataFrame, Observation]:
    """The queued rows as they are, and counters that fill while they are written: no second
    pass. ``new`` says which rows are new; all by default. The counters are there
    (``Observation.get``) once an action over the rows has ended."""
    counters = Observation("run counters")
    is_new = lit(True) if new is None else F.coalesce(new, lit(False))
    counted = queued.observe(
        counters, F.count(lit(1)).alias("last_processed"), F.count_if(is_new).alias("last_new")
    )
    return counted, counters


class StreamCounters(StreamingQueryListener):
    """Sums of the observed counters over the batches of the streams of a session.

    `counted` marks a stream's rows; a batch that is delivered again counts once."""

    NAME = "queue_counters"

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    @classmethod
    def counted(cls, rows: DataFrame, new: Column | None = None) -> DataFrame:
        is_new = lit(True) if new is None else F.coalesce(new, lit(False))
        return rows.observe(
            cls.NAME, F.count(lit(1)).alias("last_processed"), F.count_if(is_new).alias("last_new")
        )

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get(self.NAME)
        if metrics is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = metrics.asDict()

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, int]:
        return {
            name: sum(metrics[name] for metrics in self.batches.values())
            for name in ("last_processed", "last_new")
        }
