"""Queries of problems 7 (encoding) and 8 (mixing)."""

from verdigris.llm.encode import DEFAULT_DIR, encode, round_trip
from verdigris.llm.mix import mix, sized
from verdigris.runtime import materialise, read_table, spread


def _folder(spark):
    """Where the vocabulary files lie on every machine."""
    return spark.conf.get("spark.verdigris.tokenizers", DEFAULT_DIR)


def p7_ids(spark, sf_dir):
    return encode(spread(read_table(spark, sf_dir, "documents")), folder=_folder(spark))


def p7_round_trip(spark, sf_dir):
    return round_trip(spread(read_table(spark, sf_dir, "documents")), folder=_folder(spark))


def _mixed(spark, sf_dir, **how):
    sizes = materialise(sized(spread(read_table(spark, sf_dir, "documents")), folder=_folder(spark)), "mix-sizes")
    return mix(sizes, read_table(spark, sf_dir, "mix_targets"), **how)


def p8_mix(spark, sf_dir):
    """Exact target shares, as the problem has it: the scarcest source bounds the size, so the exponent is 0."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark, sf_dir):
    return _mixed(spark, sf_dir)[1]


def p8_tempered(spark, sf_dir):
    """As many tokens as the target sources have: scarce sources are repeated to their limits and the shares tempered."""
    return _mixed(spark, sf_dir, total="available")[0]


def p8_tempered_shares(spark, sf_dir):
    return _mixed(spark, sf_dir, total="available")[1]


def p8_entropy(spark, sf_dir):
    """Natural shares tempered to the entropy of the target shares, realised as blocks."""
    return _mixed(spark, sf_dir, entropy="targets")[0]


def p8_entropy_shares(spark, sf_dir):
    return _mixed(spark, sf_dir, entropy="targets")[1]


QUERIES = {f.__name__: f for f in (p7_ids, p7_round_trip, p8_mix, p8_shares, p8_tempered, p8_tempered_shares, p8_entropy, p8_entropy_shares)}
SQL = {}
