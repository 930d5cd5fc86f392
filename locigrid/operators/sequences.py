"""Sequence tables: windows, runs of windows, motifs, reads, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locigrid.functions.text import header_parts, parse_range
from locigrid.operators.joins import anti, join_null_safe, semi
from locigrid.operators.scans import consecutive_runs
from locigrid.session import cut_lineage

# Nucleotide codes, the bases each stands for, and its complement.
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
IUPAC_COMPLEMENT = {
    "A": "T", "C": "G", "G": "C", "T": "A",
    "R": "Y", "Y": "R", "S": "S", "W": "W", "K": "M", "M": "K",
    "B": "V", "D": "H", "H": "D", "V": "B", "N": "N",
}

# Bases of a contig whose windows are put in order together.
SPAN = 1 << 24

# Bases searched for motifs in one piece.
CHUNK = 8_192


def _pieces(seq: Column, size: int) -> Column:
    """The sequence cut into pieces of ``size`` letters, the last one shorter.

    One pass over the text. Taking each piece with ``substring`` would walk from
    the start every time, and exploding positions would copy the whole sequence
    next to each of them.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def sliding_fragments(seqs: DataFrame, size: int = 20_000, step: int = 20_000) -> DataFrame:
    """Full windows of each contig, 1-based and inclusive; a short tail is dropped.

    Expects ``sample, contig, seq``; the header reads
    ``{sample}_{contig}_sliding_{start}-{end}``.
    """
    span = -(-size // step)  # steps a window reaches over
    cut = seqs.withColumn("__p", _pieces(F.col("seq"), step)).filter(F.length("seq") >= size)
    windows = F.transform(
        "__p",
        lambda piece, i: F.struct(
            i.alias("i"),
            F.substring(F.array_join(F.slice("__p", i + 1, F.lit(span)), ""), 1, size).alias("piece"),
        ),
    )
    full = F.filter(windows, lambda w: F.length(w["piece"]) == size)
    rows = cut.select("sample", "contig", F.inline(full))
    start = (F.col("i").cast("long") * step + 1).cast("long")
    end = start + (size - 1)
    header = F.concat_ws("_", "sample", "contig", F.lit("sliding"), F.concat_ws("-", start, end))
    return rows.select(
        "sample", "contig", header.alias("header"), start.alias("start"), end.alias("end"),
        F.col("piece").alias("seq"),
    )


def span_windows(spans: DataFrame, span: int, size: int, step: int) -> DataFrame:
    """Full windows of records given as spans: ``contig, record, start, end, seq``, 1-based and inclusive.

    ``spans`` has contig, record, start (from 0) and seq, ``span`` letters each.
    A span gives its windows with the letters it needs from the spans after it,
    which are sent there, so no task holds a record.
    """
    reach = -(-(size - 1) // span)  # spans a window may lie in beyond its own
    number = (F.col("start") / span).cast("long")
    tagged = spans.select("contig", "record", number.alias("k"), "seq")
    # a span before needs no more than a window's letters of this one
    back = tagged.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    head = F.when(F.col("back") == 0, F.col("seq")).otherwise(F.substring("seq", 1, size - 1))
    sent = back.select("contig", "record", (F.col("k") - F.col("back")).alias("k"), "back", head.alias("seq")).filter("k >= 0")
    parts = F.sort_array(F.collect_list(F.struct("back", "seq")))
    text = F.array_join(F.transform(parts, lambda x: x["seq"]), "")
    whole = sent.groupBy("contig", "record", "k").agg(text.alias("text"))
    # the first window that starts in the span, and the text from there on in steps
    first = F.pmod(-F.col("k") * span, F.lit(step))
    whole = whole.withColumn("first", first).filter(first < span)
    cut = whole.withColumn("__p", _pieces(F.substring("text", (F.col("first") + 1).cast("int"), F.length("text")), step))
    over = -(-size // step)
    windows = F.transform(
        "__p",
        lambda piece, i: F.struct(
            (F.col("first") + i * step).alias("at"),
            F.substring(F.array_join(F.slice("__p", i + 1, F.lit(over)), ""), 1, size).alias("seq"),
        ),
    )
    full = F.filter(windows, lambda w: (F.length(w["seq"]) == size) & (w["at"] < span))
    rows = cut.select("contig", "record", "k", F.inline(full))
    start = F.col("k") * span + F.col("at") + 1
    return rows.select("contig", "record", start.alias("start"), (start + size - 1).alias("end"), "seq")


def concat_first_run(frags: DataFrame, n: int = 80, order: str = "row_order") -> DataFrame:
    """Merge the leftmost ``n`` consecutive windows of one contig per sample.

    Expects ``header, seq`` and an input-order column. The first contig of each
    sample, in input order, with a run of ``n`` windows is chosen. Its windows
    become ``{sample}_contig_{id}_concatenated_{start}-{end}``; all other rows
    pass through, and so do rows whose header holds no range.
    """
    sample, contig, window = header_parts(F.col("header"))
    start, end = parse_range(window)
    parsed = frags.withColumns(
        {"__sample": sample, "__contig": contig, "__start": start, "__end": end}
    )
    windows = parsed.filter(F.col("__start").isNotNull() & F.col("__end").isNotNull())
    # Written once without the sequences, as several steps below read it.
    runs = cut_lineage(
        consecutive_runs(
            windows.select(order, "__sample", "__contig", "__start", "__end"),
            ["__sample", "__contig"], "__start", "__end", "__run", "__place",
            bucket=F.floor(F.col("__start") / F.lit(SPAN)),
        )
    )
    per_contig = runs.groupBy("__sample", "__contig").agg(F.min(order).alias("__first"))
    long_runs = runs.groupBy("__sample", "__contig", "__run").agg(
        F.count("*").alias("__n"), F.min("__start").alias("__from")
    )
    long_runs = join_null_safe(
        long_runs.filter(F.col("__n") >= n), per_contig, ["__sample", "__contig"]
    )
    pick = F.min_by(F.struct("__contig", "__run"), F.struct("__first", "__from")).alias("p")
    chosen = long_runs.groupBy("__sample").agg(pick).select("__sample", "p.*")
    members = join_null_safe(
        runs.filter(F.col("__place") <= n), chosen, ["__sample", "__contig", "__run"], "left_semi"
    ).select("__sample", "__contig", "__start", "__end", order)
    # A group holds exactly n windows here.
    rows = F.sort_array(F.collect_list(F.struct("__start", "__end", "seq")))
    merged = (
        members.join(frags.select(order, "seq"), order)
        .groupBy("__sample", "__contig")
        .agg(rows.alias("r"), F.min(order).alias(order))
        .select(
            F.concat(
                F.col("__sample"), F.lit("_contig_"), F.coalesce("__contig", F.lit("None")),
                F.lit("_concatenated_"), F.get("r", F.lit(0))["__start"].cast("string"),
                F.lit("-"), F.get("r", F.size("r") - 1)["__end"].cast("string"),
            ).alias("header"),
            F.array_join(F.transform("r", lambda x: x["seq"]), "").alias("seq"),
            order,
        )
    )
    return anti(frags, members, [order]).select("header", "seq", order).unionByName(merged)


def samples_without_run(frags: DataFrame, merged: DataFrame) -> DataFrame:
    """Samples in which no run was merged."""
    all_samples = frags.select(header_parts(F.col("header"))[0].alias("sample"))
    done = merged.filter(F.col("header").contains("_concatenated_")).select(
        header_parts(F.col("header"))[0].alias("sample")
    )
    return all_samples.subtract(done)


def contig_bin_from_headers(fasta: DataFrame, sample: Column | str) -> DataFrame:
    """First word of each header paired with the sample."""
    label = F.lit(sample) if isinstance(sample, str) else sample
    contig = F.get(F.split("description", " "), F.lit(0))
    return fasta.select(contig.alias("contig"), label.alias("bin"))


def reverse_complement(motif: str) -> str:
    return "".join(IUPAC_COMPLEMENT[c] for c in reversed(motif))


def motif_pattern(motif: str) -> str:
    """Regular expression of a nucleotide motif."""
    return "".join(b if len(b) == 1 else f"[{b}]" for b in (IUPAC_BASES[c] for c in motif))


def _starts(seq: Column, pattern: str) -> Column:
    """0-based starts of all matches, overlapping ones included.

    A look-ahead marks each start without consuming letters; the pieces between
    the marks give the positions.
    """
    pieces = F.split(F.regexp_replace(seq, f"(?={pattern})", "|"), "[|]")
    return F.transform(
        F.slice(F.sequence(F.lit(1), F.size(pieces)), F.lit(1), F.size(pieces) - 1),
        lambda i: F.aggregate(
            F.slice(pieces, F.lit(1), i), F.lit(0), lambda acc, piece: acc + F.length(piece)
        ),
    )


def find_motifs(seqs: DataFrame, motifs: Sequence[tuple[str, str, int]], chunk: int = CHUNK) -> DataFrame:
    """Occurrences of ``(motif, mod_type, mod_position)`` on both strands.

    Long sequences are cut into pieces that overlap by the longest motif less
    one letter; an occurrence belongs to the piece its start lies in. ``start``
    is the 0-based leftmost base on the forward strand.
    """
    overlap = max(len(m) for m, _, _ in motifs) - 1
    # Each piece with the first letters of the next one.
    pieces = F.transform(
        "__p",
        lambda piece, i: F.struct(
            (i.cast("long") * chunk).alias("__offset"),
            F.concat(
                piece, F.substring(F.coalesce(F.get("__p", i + 1), F.lit("")), 1, overlap)
            ).alias("__piece"),
        ),
    )
    cut = (
        seqs.withColumn("__p", _pieces(F.col("seq"), chunk))
        .select("contig", F.inline(pieces))
        # Spread the pieces of a few long sequences over all tasks.
        .repartition("contig", "__offset")
    )
    hits = []
    for motif, mod_type, position in motifs:
        back = reverse_complement(motif)
        # a palindrome is found once and stands on both strands
        sides = ((["+", "-"], motif),) if back == motif else ((["+"], motif), (["-"], back))
        for strands, text in sides:
            starts = F.filter(
                _starts(F.col("__piece"), motif_pattern(text)), lambda i: i < F.lit(chunk)
            )
            hits.append(
                F.struct(
                    F.lit(motif).alias("motif"), F.lit(mod_type).alias("mod_type"),
                    F.lit(position).alias("mod_position"), F.lit(strands).alias("strands"),
                    starts.alias("starts"),
                )
            )
    return (
        cut.select("contig", "__offset", F.explode(F.array(*hits)).alias("h"))
        .select("contig", "__offset", "h.*")
        .select(
            "contig", "motif", "mod_type", "mod_position", "strands", "__offset",
            F.explode("starts").alias("__at"),
        )
        .withColumn("strand", F.explode("strands"))
        .withColumn("start", F.col("__offset") + F.col("__at"))
        .select("contig", "start", "strand", "motif", "mod_type", "mod_position")
    )


def extract_by_id(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose id is listed."""
    return semi(seqs, ids, ["contig"])


def reads_from_alignments(alignments: DataFrame, keep_tags: Sequence[str] = ("MM", "ML")) -> DataFrame:
    """Alignments as read records that keep the named tags.

    A read with several alignments is written once, from its primary record.
    """
    primary = alignments.filter(F.col("flag").bitwiseAND(2304) == 0)
    wanted = F.filter(
        F.split("tags", "\t"), lambda t: F.substring(t, 1, 2).isin(list(keep_tags))
    )
    return primary.select("read_id", F.array_join(wanted, "\t").alias("tags"), "seq", "qual")


def clean_bins(seqs: DataFrame, contig_bin: DataFrame, flagged: DataFrame) -> DataFrame:
    """Sequences with their bin, without the flagged (bin, contig) pairs."""
    return anti(seqs.join(contig_bin, "contig"), flagged, ["bin", "contig"])
