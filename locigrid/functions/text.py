"""String functions with the missing-value and first-match rules of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locigrid.operators.joins import lookup

# Modification code -> short name shown in labels.
MOD_TYPE_NAMES = {"a": "m6", "m": "m5", "21839": "m4"}

# A run of two or more N.
N_RUN = "NNN*"

# Colour of each confusion cell in labels.
CELL_COLOURS = {
    "true positive": "red",
    "true negative": "green",
    "false positive": "blue",
    "false negative": "orange",
}


def replace_first(column: Column, pattern: str, replacement: Column | str) -> Column:
    """Replace the first match only. ``pattern`` must not hold groups."""
    new = F.lit(replacement) if isinstance(replacement, str) else replacement
    hit = F.regexp_instr(column, F.lit(pattern))
    found = F.regexp_substr(column, F.lit(pattern))
    before = F.substring(column, F.lit(1), hit - 1)
    after = F.substring(column, hit + F.length(found), F.length(column))
    return F.when(found.isNull(), column).otherwise(F.concat(before, new, after))


def remove_first(column: Column, pattern: str) -> Column:
    return replace_first(column, pattern, "")


def paste(*parts: Column | str) -> Column:
    """Concatenate; a missing part prints as ``NA``."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(*[F.coalesce(c, F.lit("NA")) for c in cols])


def motif_key(motif: Column, mod_type: Column, mod_position: Column, sep: str = "_") -> Column:
    """``motif_type`` followed by ``sep`` and the position."""
    return F.concat(motif, F.lit("_"), mod_type, F.lit(sep), mod_position.cast("string"))


def n_run_length(motif: Column) -> Column:
    """Length of the first run of two or more N; NULL without one."""
    return F.length(F.regexp_substr(motif, F.lit(N_RUN)))


def split_at(motif: Column, position: Column) -> tuple[Column, Column, Column]:
    """Text before, at and after the 0-based position."""
    before = F.substring(motif, F.lit(1), position)
    base = F.substring(motif, position + 1, F.lit(1))
    after = F.substring(motif, position + 2, F.length(motif))
    return before, base, after


def mod_name(mod_type: Column) -> Column:
    return lookup(mod_type, MOD_TYPE_NAMES)


def motif_label(motif: Column, position: Column, mod_type: Column) -> Column:
    """Display label: the modified base in bold with its type as subscript, the
    first N run as a count. The closing tags follow the published labels."""
    before, base, after = split_at(motif, position)
    label = F.concat(
        before, F.lit("<strong>"), base, F.lit("<sub>"), F.coalesce(mod_name(mod_type), F.lit("NA")),
        F.lit("</sup></strong>"), after,
    )
    count = F.coalesce(n_run_length(motif).cast("string"), F.lit("NA"))
    return replace_first(label, N_RUN, F.concat(F.lit("(N)<sub>"), count, F.lit("</sub>")))


def highlight(label: Column, colour: Column) -> Column:
    """Wrap the label in a coloured span; labels without a colour stay as they are."""
    span = F.concat(F.lit("<span style='color:"), colour, F.lit("'>"), label, F.lit("</span>"))
    return F.when(colour.isNull(), label).otherwise(span)


def cell_label(contig: Column, cell: Column) -> Column:
    """Contig and confusion cell in the colour of the cell; NULL for an unknown cell."""
    label = F.concat(contig, F.lit(" - "), cell)
    colour = lookup(cell, CELL_COLOURS)
    return F.when(colour.isNotNull(), highlight(label, colour))


def split_pick(column: Column, separator: str, index: int) -> Column:
    """The 0-based part between separators; NULL when there are fewer parts."""
    return F.get(F.split(column, separator), F.lit(index))


def header_parts(header: Column) -> tuple[Column, Column, Column]:
    """``(sample, contig id, window)`` of ``sample_contig_id_sliding_window``,
    split at the last marker; a missing part is NULL."""
    has_window = header.contains("_sliding_")
    window = F.when(has_window, F.regexp_extract(header, r"(?s)^.*_sliding_(.*)$", 1))
    head = F.when(has_window, F.regexp_extract(header, r"(?s)^(.*)_sliding_.*$", 1)).otherwise(header)
    has_contig = head.contains("_contig_")
    contig = F.when(has_contig, F.regexp_extract(head, r"(?s)^.*_contig_(.*)$", 1))
    sample = F.when(has_contig, F.regexp_extract(head, r"(?s)^(.*)_contig_.*$", 1)).otherwise(head)
    return sample, contig, window


def parse_range(text: Column) -> tuple[Column, Column]:
    """``"start-end"`` as two numbers; NULL where the text is not a range."""
    parts = F.split(text, "-")
    whole = F.size(parts) == 2
    return tuple(F.when(whole, F.get(parts, F.lit(i)).try_cast("long")) for i in (0, 1))


def prefixed_header(sample: Column, header: Column) -> Column:
    """Header with the sample in front and ``:`` turned into ``_``."""
    return F.concat(sample, F.lit("_"), F.translate(header, ":", "_"))


def kbp_label(length: Column) -> Column:
    """Length in kilobases, halves rounded to even."""
    return F.concat(F.bround(length / 1000, 0).cast("long").cast("string"), F.lit(" kbp"))


def number_label(value: Column, digits: int = 2) -> Column:
    """Rounded number as text (halves to even), without trailing zeros."""
    fixed = F.format_string(f"%.{digits}f", F.bround(value, digits))
    return F.when(value.isNotNull(), F.regexp_replace(fixed, r"\.?0+$", "")) if digits else fixed
