"""Declared schemas of exchanged files; types are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


STR, LONG, INT, DBL, BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

TRACK = _s(track_id=STR, album_id=STR, path=STR, hf_key=STR, duration=DBL)
CANDIDATE = _s(artist_id=STR, n_tracks=LONG, primary_genre=STR, genre_coherence=DBL, total_duration_s=DBL, n_albums=LONG, tracks=T.ArrayType(TRACK))
TIER = _s(primary=CANDIDATE, fallbacks=T.ArrayType(CANDIDATE))
SELLER_CANDIDATES = _s(low=TIER, mid=TIER, high=TIER)
SUBSET_RECORD = _s(pool_index=INT, global_index=INT, dataset_id=STR, dataset_root=STR, track_id=LONG, path=STR, relpath=STR)
CAPTION = _s(caption_id=LONG, track_id=LONG, path=STR, caption=STR, duration=DBL)
MANIFEST_ITEM = _s(prompt_id=STR, prompt=STR, filename=STR, audio_path=STR, seconds_start=DBL, seconds_total=DBL, batch_seed=LONG)
PROMPT_MANIFEST = _s(items=T.ArrayType(MANIFEST_ITEM))
DATASET = _s(id=STR, path=STR, custom_metadata_module=STR)
DATASET_CONFIG = _s(dataset_type=STR, datasets=T.ArrayType(DATASET), exclude_paths_file=STR, include_paths_file=STR, random_crop=BOOL, drop_last=BOOL)
LOSS = _s(model_id=INT, query_id=STR, loss=DBL)
SCORE = _s(query=LONG, train=LONG, score=DBL)
SIMILAR_PAIR = _s(keep_path=STR, keep_relpath=STR, drop_path=STR, drop_relpath=STR, similarity=DBL)
SELLER_ROW = _s(seller_id=STR, prompt_id=STR, query_index=INT, score=DBL)
