"""Schemas of sequences, profiles, hits and registry entries."""

from __future__ import annotations

from pyspark.sql import types as T

_d, _i, _l, _s, _b = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


SEQUENCES = _struct(("source_path", _s), ("record_index", _l), ("sequence_id", _s), ("description", _s), ("residues", _s), ("length", _i), ("alphabet", _s))

CUTOFF = _struct(("seq", _d), ("dom", _d))
GUMBEL = _struct(("mu", _d), ("lambda", _d))
TAIL = _struct(("tau", _d), ("lambda", _d))
_matrix = T.ArrayType(T.ArrayType(_d))

PROFILES = _struct(
    ("source_path", _s), ("profile_index", _l), ("format_version", _s), ("name", _s), ("accession", _s), ("description", _s),
    ("model_length", _i), ("max_length", _i), ("alphabet", _s), ("nseq", _i), ("effn", _d), ("cksum", _l),
    ("ga", CUTOFF), ("tc", CUTOFF), ("nc", CUTOFF), ("stats_msv", GUMBEL), ("stats_viterbi", GUMBEL), ("stats_forward", TAIL),
    ("compo", T.ArrayType(_d)), ("match_nlog", _matrix), ("insert_nlog", _matrix), ("trans_nlog", _matrix), ("consensus", _s), ("map", T.ArrayType(_i)),
)

RAW_DOMAIN = _struct(("score", _d), ("bias", _d), ("lnp", _d), ("env_from", _i), ("env_to", _i), ("ali_from", _i), ("ali_to", _i), ("hmm_from", _i), ("hmm_to", _i))

#: What a scoring kernel gives: one row for each profile and sequence that pass its filters, before any threshold of the user.
RAW_HITS = _struct(
    ("source_path", _s), ("record_index", _l), ("sequence_id", _s), ("profile_index", _l), ("hmm_name", _s), ("strand", _s),
    ("seq_score", _d), ("seq_bias", _d), ("seq_lnp", _d), ("domains", T.ArrayType(RAW_DOMAIN, False)),
)

DOMAIN = _struct(("c_evalue", _d), ("i_evalue", _d), ("bitscore", _d), ("env_from", _i), ("env_to", _i), ("ali_from", _i), ("ali_to", _i))

#: The public result: one row for each domain, 11 columns in this order.
RESULT = _struct(
    ("sequence_id", _s), ("hmm_name", _s), ("evalue", _d), ("bitscore", _d), ("c_evalue", _d), ("i_evalue", _d),
    ("dom_bitscore", _d), ("env_from", _i), ("env_to", _i), ("ali_from", _i), ("ali_to", _i),
)

DATABASES = _struct(
    ("name", _s), ("url", _s), ("molecule_type", _s), ("domain", _b), ("has_thresholds", _b), ("citation", _s), ("notes", _s),
    ("installed", _b), ("path", _s), ("version", _s), ("custom", _b),
)
