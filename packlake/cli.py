"""packlake pack | unpack | ls | verify | manifest | convert-wds | convert-parquet | convert-lance"""

from __future__ import annotations

import argparse
import json
import os
import sys

from .errors import PackError


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="packlake", description="Datasets with their media in zip shards.")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: str):
        c = commands.add_parser(name, help=text)
        for a in arguments:
            c.add_argument(a)
        return c

    for name, text in (("pack", "pack a tree of files"), ("convert-wds", "pack the files of tar archives")):
        c = command(name, text, "src", "dst")
        c.add_argument("--ref-base")
        c.add_argument("--max-pack-bytes", type=int, default=4 << 30)
        if name == "convert-wds":
            c.add_argument("--shard-prefix", action="store_true")
    command("unpack", "write blobs to files", "src", "dst")
    command("ls", "list size, shard and key of blobs", "src")
    command("verify", "check every byte", "src")
    command("manifest", "record digests", "src").add_argument("--force", action="store_true")
    c = command("convert-parquet", "move binary fields of Parquet files into packs", "src", "dst")
    c.add_argument("--column", action="append")
    c.add_argument("--field", nargs="+", action="append")
    c.add_argument("--max-pack-bytes", type=int, default=4 << 30)
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--yes", action="store_true")
    c = command("convert-lance", "move payload columns of a Lance table into packs", "src", "dst")
    c.add_argument("--column", action="append")
    c.add_argument("--yes", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    return parser


def _pack(a, spark) -> int:
    from .operators import convert
    from .plans.layout import Limits

    options = {"ref_base": a.ref_base, "limits": Limits(a.max_pack_bytes)}
    if a.command == "pack":
        done = convert.pack_files(spark, a.src, a.dst, **options)
    else:
        done = convert.pack_tars(spark, a.src, a.dst, shard_prefix=a.shard_prefix, **options)
    blobs, size, last = done.selectExpr("count(*)", "sum(size)", "max(shard_id)").first()
    print(f"{a.dst}: {blobs} blobs, {size:,} bytes, {last + 1} shards")
    return 0


def _unpack(a, spark) -> int:
    from .operators import convert
    from .operators.packs import Pack

    print(f"{a.dst}: {convert.unpack(Pack(spark, a.src), a.dst)} blobs")
    return 0


def _ls(a, spark) -> int:
    from .operators.packs import Pack

    pack = Pack(spark, a.src)
    pack.check_unique()
    for r in pack.index().orderBy("shard", "ordinal").select("size", "shard", "key").toLocalIterator():
        print(r.size, r.shard, r.key, sep="\t")
    return 0


def _manifest(a, spark) -> int:
    from .operators import integrity

    _some_shards(a.src)
    print(f"digests are in {integrity.write_manifest(spark, a.src, a.force)}")
    return 0


def _verify(a, spark) -> int:
    from .operators import integrity

    _some_shards(a.src)
    problems, totals = integrity.verify(spark, a.src)
    bad = 0
    for bad, r in enumerate(problems.orderBy("shard", "key").toLocalIterator(), 1):
        print("\t".join(filter(None, ("BAD", r.shard, r.key, r.kind, r.detail))))
    print(f"{'OK' if not bad else f'BAD, {bad} findings'}: " + ", ".join(f"{v} {k}" for k, v in totals.first().asDict().items()))
    return min(bad, 1)


def _some_shards(folder: str) -> None:
    from .operators import integrity

    if not integrity.list_files(folder):
        raise FileNotFoundError(f"no shards in {folder}")


def _convert_parquet(a, spark) -> int:
    from .operators import convert
    from .plans.layout import Limits

    found = convert.plan_parquet(a.src, a.column, a.field)
    for key, value in found.items():
        print(f"{key}: {json.dumps(value)}")
    if not a.dry_run and _agreed(a.yes):
        convert.convert_parquet(spark, a.src, a.dst, columns=a.column, fields=a.field, limits=Limits(a.max_pack_bytes))
    return 0


def _agreed(said: bool) -> bool:
    """Whether to go on: said on the command line, or asked where somebody can answer."""
    if said or sys.stdin.isatty():
        return said or input("go on? [y/N] ").lower().startswith("y")
    raise PackError("nobody can be asked here; --yes goes on without asking")


def _convert_lance(a, spark) -> int:
    from .operators import convert

    if a.yes and not a.column:
        raise FileNotFoundError("--yes needs the columns, by --column")
    convert.convert_lance(a.src, a.dst)
    return 0


COMMANDS = {
    "pack": _pack, "convert-wds": _pack, "unpack": _unpack, "ls": _ls, "manifest": _manifest, "verify": _verify,
    "convert-parquet": _convert_parquet, "convert-lance": _convert_lance,
}


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("packlake").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return COMMANDS[a.command](a, spark)
    except (PackError, ValueError, FileNotFoundError, FileExistsError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2 if isinstance(e, OSError) else 1  # 2: what was asked for can't be begun
    except BrokenPipeError:  # whoever read the list has seen enough
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0


if __name__ == "__main__":
    sys.exit(main())
