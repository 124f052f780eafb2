"""Splitting oversized texts at natural boundaries, with an overlap between consecutive pieces.

Method: one regular expression with bounded quantifiers, extracted over the whole text.  Its alternatives stand in the
order of the strength of the boundary they end at; each takes as many characters as the limit allows, and the last
one cuts anywhere.  Overlap is looked back from the end of the piece before.  All of it are SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand before and after a cut, strongest first; everything is of bounded length.
SEAMS = (
    # a blank line before something that starts in the first column
    (r"(?<=\n[ \t]{0,16}\r?\n)", r"(?=[^\s)\]}])"),
    # any blank line
    (r"(?<=\n[ \t]{0,16}\r?\n|\r[ \t]{0,16}\r)", r"(?![\r\n])"),
    # a line end before a line that is not indented and does not close a bracket
    (r"(?<=\n|\r)", r"(?=[^\s)\]}])"),
    # any line end
    (r"(?<=\n|\r)", r"(?!\n)"),
    # a sentence end
    (r"(?<=[.!?…][\"')\]»”]{0,3}\s|[。！？])", r"(?![\s。！？”』」])"),
    # a clause or statement end
    (r"(?<=[;,:)\]}]\s|[；，：、])", r"(?!\s)"),
    # a blank
    (r"(?<=\s)", r"(?!\n)"),
    # between characters, not before a combining mark, joiner or line feed
    ("", r"(?![\p{M}‍\n])"),
    ("", ""),
)


def seam_pattern(limit: int, overlap: int) -> str:
    """The expression for pieces of at most ``limit`` characters, ``overlap`` of which may repeat the piece before."""
    if limit < 1 or overlap < 0 or overlap * 2 > limit:
        raise ValueError("needs limit >= 1 and 0 <= overlap <= limit / 2")

    def upto(most: int) -> str:
        least = max(1, most // 2)
        return "|".join([rf".{{1,{most}}}\z", *(f".{{{least},{most}}}{before}{after}" for before, after in SEAMS[:-1]), f".{{1,{most}}}"])

    return rf"(?s)\A(?:{upto(limit)})|(?:{upto(limit - overlap)})"


def _lookback(core: Column, overlap: int) -> Column:
    """The end of a piece, at most ``overlap`` characters, from the start of a word where it has one."""
    if not overlap:
        return F.lit("")
    word = F.regexp_extract(F.right(core, F.lit(overlap + 1)), r"(?s)\s(\S.*)\z", 1)
    return F.when(word != "", word).otherwise(F.right(core, F.lit(overlap)))


#: Pieces whose sizes are summed one by one; the sums of whole runs of so many are kept.
RUN = 64


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda n, size: n + size)


def _offsets(sizes: str) -> Column:
    """What stands before each piece: whole runs of RUN pieces, summed once, and the rest of its own run.

    A fold over all pieces would copy its array for each of them.
    """
    runs = F.floor((F.size(sizes) - 1) / RUN).cast("int")
    whole = F.when(runs > 0, F.transform(F.sequence(F.lit(0), runs - 1), lambda r: _total(F.slice(sizes, r * RUN + 1, F.lit(RUN))))).otherwise(F.array().cast("array<bigint>"))
    before = F.aggregate(whole, F.array(F.lit(0).cast("bigint")), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    return F.transform(sizes, lambda _, i: F.element_at(before, (i / RUN).cast("int") + 1) + _total(F.slice(sizes, (i / RUN).cast("int") * RUN + 1, i % RUN)))


def split_oversized(records: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of every (rec, text) with more than ``limit`` characters (code points).

    Returns (rec, piece, n_pieces, start, overlap, text): ``piece`` counts from 1, ``start`` is the offset of the piece
    in the text, its first ``overlap`` characters are the last ones of the piece before, and dropping them from each
    piece and concatenating gives the text back.  Null, empty and short texts give no rows; repeated recs are split
    row by row.  Extra columns are ignored.
    """
    long = records.where(F.char_length("text") > limit).select("rec", F.regexp_extract_all("text", F.lit(seam_pattern(limit, overlap)), F.lit(0)).alias("cores"))
    long = long.withColumn("sizes", F.transform("cores", F.char_length))
    back = F.transform("cores", lambda c, i: F.when(i == 0, "").otherwise(_lookback(F.get("cores", i - 1), overlap)))
    packed = long.select("rec", F.size("cores").alias("n_pieces"), F.posexplode(F.arrays_zip("cores", back.alias("back"), _offsets("sizes").alias("at"))).alias("i", "x"))
    return packed.select("rec", (F.col("i") + 1).alias("piece"), "n_pieces", (F.col("x.at") - F.char_length("x.back")).alias("start"), F.char_length("x.back").alias("overlap"), F.concat("x.back", "x.cores").alias("text"))
