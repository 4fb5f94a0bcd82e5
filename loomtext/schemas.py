"""Explicit schemas of the state tables."""

from pyspark.sql import types as T


def _s(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


L, S, TS, D, I, B = T.LongType(), T.StringType(), T.TimestampType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

SERIES = _s(id=L, name=S, url=S, source=S, narrator=S, latest_url=S, last_scraped_at=TS, created_at=TS, updated_at=TS)
CHAPTERS = _s(
    id=L, series_id=L, title=S, published_date=S, source_url=S, chapter_index=L, raw_path=S, output_path=S,
    status=S, error=S, retry_count=I, scraped_at=TS, checked_at=TS, created_at=TS, updated_at=TS, duration_s=D,
)
JOB_EVENTS = _s(
    seq=L, ts=TS, type=S, job_id=S, series=S, chapter=S, raw_path=S, chars_done=L, chars_total=L,
    index=I, total=I, message=S, error=S,
)
CHUNKS = _s(doc_id=L, part_pos=I, chunk_idx=I, speaker=S, is_system=B, text=S, chars=I)
TOC = _s(series=S, pos=I, link_text=S, url=S, chapter_order=L, pub_date=S)
