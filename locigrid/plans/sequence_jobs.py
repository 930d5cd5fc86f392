"""Sequences, intervals, depth and motifs."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locigrid.operators import intervals as iv
from locigrid.operators import sequences as sq
from locigrid.plans.catalog import query
from locigrid.plans.standins import (
    INTERVAL_SPAN,
    INTERVALS,
    SEQUENCES,
    interval_lengths,
    intervals,
    r6,
    sequences,
    table,
)
from locigrid.session import work_path
from locigrid.sources import sequences as seq_io
from locigrid.sources import sinks

STEPS = """steps AS (SELECT contig, pos, sum(d) AS d FROM (SELECT contig, start AS pos, 1 AS d FROM intervals UNION ALL
    SELECT contig, "end", -1 FROM intervals) GROUP BY 1, 2)"""
SEGMENTS = f"""{STEPS}, segments AS (SELECT * FROM (SELECT contig, pos AS start, lead(pos) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth
    FROM steps WHERE d <> 0 WINDOW w AS (PARTITION BY contig ORDER BY pos)) WHERE depth > 0)"""


@query("W08 S09", f"WITH {INTERVALS}, {SEGMENTS} SELECT * FROM segments")
def covered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal segments of constant depth, covered ones only."""
    return iv.depth_segments(intervals(spark, sf_dir), tile=4_096)


@query(
    "W08",
    f"""WITH {INTERVALS}, {STEPS}, ids AS (SELECT DISTINCT contig FROM intervals), b AS (SELECT contig, pos, sum(d) AS d FROM (SELECT * FROM steps WHERE d <> 0 UNION ALL
          SELECT contig, 0, 0 FROM ids UNION ALL SELECT contig, {INTERVAL_SPAN}, 0 FROM ids) GROUP BY 1, 2)
        SELECT * FROM (SELECT contig, CAST(pos AS BIGINT) AS start, CAST(lead(pos) OVER w AS BIGINT) AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM b WINDOW w AS (PARTITION BY contig ORDER BY pos)) WHERE "end" IS NOT NULL""",
)
def all_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that cover each contig whole, zero depth included."""
    return iv.depth_segments(intervals(spark, sf_dir), interval_lengths(spark, sf_dir))


WINDOWS = """windows AS (SELECT DISTINCT contig, (start // 1440) * 1440 AS start, (start // 1440) * 1440 + 1440 AS "end" FROM intervals)"""


def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("start") / 1440) * 1440
    return intervals(spark, sf_dir).select("contig", day.alias("start"), (day + 1440).alias("end")).distinct()


@query(
    "J11",
    f"""WITH {INTERVALS}, {WINDOWS} SELECT w.contig, w.start, w."end", round(CAST(coalesce(sum(least(w."end", i."end") - greatest(w.start, i.start)), 0) AS DOUBLE) / 1440, 6) AS mean_depth
        FROM windows w LEFT JOIN intervals i ON i.contig = w.contig AND i.start < w."end" AND w.start < i."end" GROUP BY 1, 2, 3""",
)
def mean_depth_of_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean depth of each window, without building overlap pairs."""
    out = iv.mean_depth(day_windows(spark, sf_dir), intervals(spark, sf_dir), tile=8_192)
    return out.withColumn("mean_depth", r6(F.col("mean_depth")))


@query(
    "A07 W08",
    f"""WITH {INTERVALS}, {SEGMENTS} SELECT contig, round(avg(depth), 6) AS mean_depth, round(stddev_samp(depth), 6) AS sd_depth FROM segments GROUP BY 1""",
)
def depth_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iv.depth_summary(iv.depth_segments(intervals(spark, sf_dir)))
    return out.withColumns({c: r6(F.col(c)) for c in ("mean_depth", "sd_depth")})


# Sample-wise coverage: contig = user, sample = event type, over the whole span.
_BY_SAMPLE = """bs AS (SELECT contig || '@' || sample AS contig, start, "end" FROM intervals)"""
COVERAGE = f"""{INTERVALS}, {_BY_SAMPLE}, st AS (SELECT contig, pos, sum(d) AS d FROM (SELECT contig, start AS pos, 1 AS d FROM bs UNION ALL SELECT contig, "end", -1 FROM bs) GROUP BY 1, 2),
  sg AS (SELECT * FROM (SELECT contig, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS depth FROM st WHERE d <> 0 WINDOW w AS (PARTITION BY contig ORDER BY pos)) WHERE depth > 0),
  cov AS (SELECT split_part(contig, '@', 1) AS contig, split_part(contig, '@', 2) AS sample, CAST(sum("end" - start) AS DOUBLE) / 43200 AS coverage FROM sg GROUP BY 1, 2)"""


def sample_coverage(spark: SparkSession, sf_dir: str, minimum: float) -> DataFrame:
    both = F.concat_ws("@", "contig", "sample")
    rows = intervals(spark, sf_dir).select(both.alias("contig"), "start", "end")
    segments = iv.depth_segments(rows).withColumns(
        {"sample": F.split_part("contig", F.lit("@"), F.lit(2)), "contig": F.split_part("contig", F.lit("@"), F.lit(1))}
    )
    lengths = interval_lengths(spark, sf_dir).withColumn("length", F.lit(43_200))
    return iv.coverage_fraction(segments, lengths, minimum)


@query("A24", f"WITH {COVERAGE} SELECT contig, sample, round(coverage, 6) AS coverage FROM cov WHERE coverage >= 0.02")
def covered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered bases over length per contig and sample."""
    return sample_coverage(spark, sf_dir, 0.02).withColumn("coverage", r6(F.col("coverage")))


@query(
    "A25 A08 F02",
    f"WITH {COVERAGE}, g AS (SELECT * FROM cov WHERE coverage > 0.03) SELECT contig, min(sample) AS bin FROM g GROUP BY 1 HAVING count(*) = 1 ORDER BY 2, 1",
)
def unique_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs that are well covered in exactly one sample."""
    return iv.unique_mapping(sample_coverage(spark, sf_dir, 0.0), 0.03)


WINDOW = 500
FRAGMENTS = f"""{SEQUENCES}, fr AS (SELECT sample, contig, seq, unnest(range(0, length(seq) // {WINDOW})) AS i FROM seqs),
  fragments AS (SELECT sample, contig, sample || '_' || contig || '_sliding_' || (i * {WINDOW} + 1) || '-' || ((i + 1) * {WINDOW}) AS header,
    CAST(i * {WINDOW} + 1 AS BIGINT) AS start, CAST((i + 1) * {WINDOW} AS BIGINT) AS "end", substr(seq, i * {WINDOW} + 1, {WINDOW}) AS seq FROM fr)"""


@query("Q01", f"WITH {FRAGMENTS} SELECT * FROM fragments")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full windows of every sequence, with their headers."""
    return sq.sliding_fragments(sequences(spark, sf_dir), WINDOW, WINDOW)


SPAN, SIZE, STEP = 1_000, 700, 300


@query(
    "Q01 S07",
    f"""WITH {SEQUENCES}, w AS (SELECT contig, seq, unnest(range(0, length(seq) - {SIZE} + 1, {STEP})) AS i FROM seqs WHERE length(seq) >= {SIZE})
        SELECT contig, CAST(i + 1 AS BIGINT) AS start, CAST(i + {SIZE} AS BIGINT) AS "end", substr(seq, i + 1, {SIZE}) AS seq FROM w""",
)
def windows_of_long_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of sequences that are read, joined and cut in spans."""
    path = work_path(spark, "fasta")
    sinks.write_fasta(sequences(spark, sf_dir).select("contig", "seq"), path)
    spans = seq_io.read_fasta_spans(spark, path, SPAN)
    return sq.span_windows(spans, SPAN, SIZE, STEP).drop("record")


RUN = 4


def gapped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window records in input order; every seventh window of a document is
    missing, and in some samples every third, which breaks the runs."""
    docs = sequences(spark, sf_dir).withColumns(
        {"number": F.substring("contig", 5, 20).cast("long"), "contig": F.regexp_replace("contig", "doc_", "contig_")}
    )
    cut = sq.sliding_fragments(docs.select("sample", "contig", "seq"), WINDOW, WINDOW)
    place = F.floor(F.col("start") / WINDOW)
    number = F.substring("contig", 8, 20).cast("long")
    every = F.when(F.col("sample").endswith("3"), 3).otherwise(7)
    rows = cut.filter((place + number) % every != 0)
    return rows.select("header", "seq", (number * 1_000_000 + place).alias("row_order"))


GAPPED = f"""{FRAGMENTS}, g AS (SELECT sample, replace(contig, 'doc_', 'contig_') AS contig, replace(header, '_doc_', '_contig_') AS header, start, "end", seq, start // {WINDOW} AS place,
    CAST(substr(contig, 5) AS BIGINT) AS number FROM fragments),
  gw AS (SELECT *, number * 1000000 + place AS row_order FROM g WHERE (place + number) % (CASE WHEN ends_with(sample, '3') THEN 3 ELSE 7 END) <> 0),
  fl AS (SELECT *, CASE WHEN lag("end") OVER w + 1 = start THEN 0 ELSE 1 END AS b FROM gw WINDOW w AS (PARTITION BY sample, contig ORDER BY start)),
  ru AS (SELECT *, sum(b) OVER (PARTITION BY sample, contig ORDER BY start) AS run FROM fl),
  pl AS (SELECT *, row_number() OVER (PARTITION BY sample, contig, run ORDER BY start) AS k, count(*) OVER (PARTITION BY sample, contig, run) AS n,
    min(row_order) OVER (PARTITION BY sample, contig) AS fo FROM ru),
  ch AS (SELECT * FROM (SELECT sample, contig, run, row_number() OVER (PARTITION BY sample ORDER BY fo, start) AS q FROM pl WHERE n >= {RUN} AND k = 1) WHERE q = 1),
  used AS (SELECT pl.* FROM pl JOIN ch ON ch.sample = pl.sample AND ch.contig = pl.contig AND ch.run = pl.run WHERE k <= {RUN})"""


@query(
    "Q02 W06 N05 C09 C10",
    f"""WITH {GAPPED} SELECT header, seq, row_order FROM gw WHERE row_order NOT IN (SELECT row_order FROM used) UNION ALL
        SELECT sample || '_' || contig || '_concatenated_' || min(start) || '-' || max("end"), string_agg(seq, '' ORDER BY start), min(row_order) FROM used GROUP BY sample, contig""",
)
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run of consecutive windows per sample, merged."""
    return sq.concat_first_run(gapped_windows(spark, sf_dir), RUN)


@query("U03 Q02", f"WITH {GAPPED} SELECT DISTINCT sample FROM gw EXCEPT SELECT sample FROM ch")
def samples_without_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in which no run was long enough; there may be none."""
    rows = gapped_windows(spark, sf_dir)
    return sq.samples_without_run(rows, sq.concat_first_run(rows, RUN))


# Motifs with their modified position, as in published tables.
MOTIFS = [("GATC", "a", 1), ("CCWGG", "m", 1), ("RGATCY", "a", 2)]


def _motif_sql() -> str:
    """Every position with its next six letters, compared with all spellings of
    each motif."""
    parts = []
    for motif, mod_type, position in MOTIFS:
        for strand, text in (("+", motif), ("-", sq.reverse_complement(motif))):
            spellings = itertools.product(*[sq.IUPAC_BASES[c] for c in text])
            listed = ", ".join("'" + "".join(x) + "'" for x in spellings)
            parts.append(
                f"""SELECT contig, start, '{strand}' AS strand, '{motif}' AS motif, '{mod_type}' AS mod_type,
                      {position} AS mod_position FROM k WHERE substr(six, 1, {len(text)}) IN ({listed})"""
            )
    return " UNION ALL ".join(parts)


LETTERS = """letters AS (SELECT contig, unnest(string_split(seq, '')) AS c, unnest(range(length(seq))) AS start FROM seqs WHERE seq <> ''),
  k AS (SELECT contig, start, c || coalesce(lead(c, 1) OVER w, '') || coalesce(lead(c, 2) OVER w, '') || coalesce(lead(c, 3) OVER w, '')
    || coalesce(lead(c, 4) OVER w, '') || coalesce(lead(c, 5) OVER w, '') AS six FROM letters WINDOW w AS (PARTITION BY contig ORDER BY start))"""


@query("Q04", f"WITH {SEQUENCES}, {LETTERS} {_motif_sql()}")
def motif_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of three motifs on both strands, overlapping ones included."""
    return sq.find_motifs(sequences(spark, sf_dir), MOTIFS, chunk=2_000)


@query(
    "Q05 J07",
    f"WITH {SEQUENCES} SELECT contig, seq FROM seqs WHERE contig IN (SELECT 'doc_' || doc_id FROM labels WHERE quality = 1)",
)
def extracted_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose id is listed."""
    ids = table(spark, sf_dir, "labels").filter("quality = 1")
    ids = ids.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("contig"))
    return sq.extract_by_id(sequences(spark, sf_dir).select("contig", "seq"), ids)


@query(
    "Q06",
    f"""WITH {SEQUENCES} SELECT contig AS read_id, 'MM:Z:C' || chr(9) || 'ML:B:1' AS tags, seq, translate(seq, 'ACGT', '#I5~') AS qual FROM seqs
        WHERE (CAST(substr(contig, 5) AS BIGINT) & 2304) = 0""",
)
def reads_of_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments as read records that keep the modification tags."""
    rows = sequences(spark, sf_dir).select(
        F.col("contig").alias("read_id"),
        F.substring("contig", 5, 20).cast("long").alias("flag"),
        F.lit("NM:i:0\tMM:Z:C\tML:B:1").alias("tags"),
        "seq",
        F.translate("seq", "ACGT", "#I5~").alias("qual"),
    )
    return sq.reads_from_alignments(rows)


@query(
    "Q07 J08",
    f"""WITH {SEQUENCES} SELECT contig, seq, sample AS bin FROM seqs
        WHERE contig NOT IN (SELECT 'doc_' || doc_id FROM labels WHERE toxic = 1)""",
)
def cleaned_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with their bin, without the flagged contigs."""
    rows = sequences(spark, sf_dir)
    pairs = rows.select("contig", F.col("sample").alias("bin"))
    flagged = table(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("contig")
    )
    flagged = flagged.join(pairs, "contig")
    return sq.clean_bins(rows.select("contig", "seq"), pairs, flagged)
