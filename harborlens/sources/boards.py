"""Job boards of four vendors as one relation, with what became of each request."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Board:
    """Where a vendor's JSON keeps the list of jobs and a job's fields: paths in the order in which they are tried. ``odd`` is the outcome of another shape."""

    jobs: Sequence[str]
    id: Sequence[str]
    title: Sequence[str]
    location: Sequence[str]
    url: Sequence[str]
    posted: Sequence[str]
    department: Sequence[str]
    content: Sequence[str]
    odd: str = "error"
    may_lack_jobs: bool = True
    joined: Sequence[str] = field(default=())  # contents that are put together


# The vendors' formats.
BOARDS = {
    "greenhouse": Board(
        ["$.jobs"], ["$.id"], ["$.title"], ["$.location.name"], ["$.absolute_url"], ["$.updated_at", "$.first_published"], ["$.departments[0].name"], ["$.content"],
    ),
    "lever": Board(
        ["$"], ["$.id"], ["$.text"], ["$.categories.location"], ["$.hostedUrl", "$.applyUrl"], ["$.createdAt"], ["$.categories.team", "$.categories.department"], [],
        may_lack_jobs=False, joined=("$.descriptionPlain", "$.additionalPlain"),
    ),
    "ashby": Board(
        ["$.jobs"], ["$.id"], ["$.title"], ["$.location"], ["$.jobUrl", "$.applyUrl"], ["$.publishedAt"], ["$.department", "$.team"], ["$.descriptionPlain", "$.descriptionHtml"],
    ),
    "rippling": Board(
        ["$", "$.items"], ["$.uuid", "$.id"], ["$.name", "$.title"], ["$.workLocation.label", "$.location"], ["$.url"], ["$.createdAt", "$.publishedAt"], ["$.department.label", "$.department"],
        ["$.jobDescription", "$.description"], odd="not_found", may_lack_jobs=False,
    ),
}
FIELDS = ("external_id", "title", "location", "url", "posted_at", "department", "content")


def _first(v: Column, paths: Sequence[str], kind: str = "string") -> Column:
    return F.coalesce(*(F.try_variant_get(v, p, kind) for p in paths)) if paths else F.lit(None).cast(kind)


def _posted(v: Column, paths: Sequence[str]) -> Column:
    """A time as milliseconds or as text."""
    at = F.coalesce(F.timestamp_millis(_first(v, paths, "bigint")), F.try_to_timestamp(_first(v, paths)))
    return F.when(F.coalesce(_first(v, paths), F.lit("")) != "", at)


def board_jobs(responses: DataFrame, vendor: str, status: str, body: str, *keep: str) -> DataFrame:
    """Over responses (``keep`` columns, vendor, HTTP status, body): outcome, and for each job external_id, title, location, url, posted_at, department, content.

    Outcome is ok, not_found (404) or error (another status, no JSON, an unknown vendor, or another shape than the vendor's); a board that isn't ok or has no jobs is one
    row without a job. Jobs without title or address are left out. One vendor lists a job once for each place: such rows of an id
    are one job, whose places are joined in their order; its jobs without an address get the board's.

    A body is parsed once, as a VARIANT, and the fields are taken by the vendor's paths (``BOARDS``). ``keep`` must tell responses apart.
    """
    v, kind = F.col("_v"), F.col(vendor)

    def by_vendor(f: Callable[[Board], Column]) -> Column:
        out = None
        for name, board in BOARDS.items():
            out = F.when(kind == name, f(board)) if out is None else out.when(kind == name, f(board))
        return out

    rows = responses.withColumn("_v", F.try_parse_json(body))
    jobs = by_vendor(lambda b: _first(v, b.jobs, "array<variant>"))
    lacks = by_vendor(lambda b: F.lit(b.may_lack_jobs) & F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & _first(v, b.jobs).isNull())
    empty = F.array().cast("array<variant>")
    rows = rows.withColumn("_jobs", F.when(F.col(status) == 200, F.coalesce(jobs, F.when(lacks, empty))))
    outcome = F.when(F.col("_jobs").isNotNull(), "ok").when(F.col(status) == 404, "not_found").when(F.col(status) != 200, "error").otherwise(F.coalesce(F.when(v.isNotNull(), by_vendor(lambda b: F.lit(b.odd))), F.lit("error")))
    rows = rows.select(*keep, kind.alias("vendor"), outcome.alias("outcome"), F.posexplode_outer("_jobs").alias("_at", "_v"))
    kind = F.col("vendor")
    told = {
        "external_id": by_vendor(lambda b: _first(v, b.id)), "title": F.trim(by_vendor(lambda b: _first(v, b.title))), "location": F.trim(by_vendor(lambda b: _first(v, b.location))),
        "url": by_vendor(lambda b: _first(v, b.url)), "posted_at": by_vendor(lambda b: _posted(v, b.posted)), "department": by_vendor(lambda b: _first(v, b.department)),
        "content": by_vendor(lambda b: F.nullif(F.concat_ws(" ", *(_first(v, [p]) for p in b.joined)), F.lit("")) if b.joined else _first(v, b.content)),
    }
    rows = rows.withColumns(told).drop("_v")
    once = kind == "rippling"
    given = F.when(once, F.coalesce(F.col("external_id"), F.lit("")) != "").otherwise(F.coalesce(F.col("url"), F.lit("")) != "") & (F.coalesce(F.col("title"), F.lit("")) != "")
    rows = rows.withColumn("_given", given & F.col("_at").isNotNull())
    # Each board keeps a row: its jobs, or one without any.
    places = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("location").isNotNull(), F.struct("_at", "location")))), lambda x: x["location"]))
    first = F.min_by(F.struct(*(f for f in FIELDS if f not in ("external_id", "location"))), "_at")
    job = F.when(F.col("_given"), F.when(once, F.col("external_id")).otherwise(F.concat(F.lit("#"), F.col("_at"))))
    grouped = rows.groupBy(*keep, "vendor", "outcome", job.alias("_job")).agg(F.min(F.when(F.col("_given"), F.col("external_id"))).alias("external_id"), first.alias("_f"), F.nullif(F.array_join(places, "; "), F.lit("")).alias("location"))
    some = grouped.where("_job is not null").select(*keep, "vendor", "outcome", "external_id", "_f.title", "location", "_f.url", "_f.posted_at", "_f.department", "_f.content")
    boards = grouped.groupBy(*keep, "vendor", "outcome").agg(F.count("_job").alias("_n")).where("_n = 0").drop("_n")
    return some.unionByName(boards, allowMissingColumns=True)
