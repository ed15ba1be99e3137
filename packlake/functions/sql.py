"""References and payloads in SQL: temporary functions of a session.

    SELECT ref_key(r), ref_shard(r), kind_of_blob(b) FROM t
    SELECT t.id, x.payload FROM t, LATERAL read_range(t.r, 0, 100) AS x
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import refs

_PART = "CASE WHEN r RLIKE '{0}' THEN regexp_extract(r, '{0}', {1}) END"


def register_refs(spark: SparkSession) -> None:
    """make_ref(key, path), ref_key(ref), ref_path(ref), ref_shard(ref); null for what is no reference."""
    pattern = refs.REFERENCE
    key, path = _PART.format(pattern, 1), _PART.format(pattern, 2)
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{create} make_ref(k STRING, p STRING) RETURNS STRING RETURN concat('{refs.SCHEME}', k, '{refs.SEPARATOR}', p)")
    spark.sql(f"{create} ref_key(r STRING) RETURNS STRING RETURN {key}")
    spark.sql(f"{create} ref_path(r STRING) RETURNS STRING RETURN {path}")
    spark.sql(f"{create} ref_shard(r STRING) RETURNS STRING RETURN element_at(split({path}, '/'), -1)")


def register_reader(spark: SparkSession, folder: str, ref_base: str | None = None, name: str = "read_range") -> None:
    """A table function (ref, start, length) -> payload over one pack; no row for a null reference. A length of null
    reads to the end. For many references Pack.resolve() is faster, as it reads shards in order."""
    from ..sources.ranges import Handles, list_files
    from ..sources.shards import Shard

    paths = dict(list_files(folder))
    base = refs.default_base(folder) if ref_base is None else ref_base

    @udtf(returnType="payload: binary")
    class ReadRange:
        def __init__(self):
            self._handles = Handles(lambda n: Shard(paths[n]))

        def eval(self, ref, start, length):
            if ref is None:
                return
            key, path = refs.split_ref(ref)
            folder_, _, shard = path.rpartition("/")
            if (base and folder_ != base) or shard not in paths:
                raise KeyError(f"not of this pack: {ref!r}")
            opened = self._handles.get(shard)
            i = opened.index_of(key)
            yield (opened.read_range(i, start or 0, opened.span(i)[1] if length is None else length),)

        def terminate(self):
            self._handles.close()

    spark.udtf.register(name, ReadRange)
