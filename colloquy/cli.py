"""Command line: ``python -m colloquy.cli analyse SRC --annotator NAME -o DIR`` and the like."""

from __future__ import annotations

import argparse
import json
import sys

from colloquy import contract, views
from colloquy.operators import audit, facts, taxonomy
from colloquy.operators import board as B
from colloquy.session import get_session
from colloquy.sources.files import ndjson, write_jsonl


TEMPLATE = '''"""NAME: questions that nobody answered. Replace annotate() with your own method and register the class
under the entry-point group colloquy.annotators."""

from colloquy.operators import taxonomy


class Annotator:
    """Open questions and bare claims."""

    name, version, taxonomy = "NAME", "0.1.0", "state_gap"
    schema = "pattern string, room string, seq bigint, who string, signal string, excerpt string, group string"

    def annotate(self, board):
        return taxonomy.kickstart(board.posts, self.taxonomy)
'''


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="colloquy")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse", help="run an annotator over a source")
    a.add_argument("src")
    a.add_argument("--annotator", default="modes_v1")
    a.add_argument("--source", default="auto")
    a.add_argument("-o", "--out")
    a.add_argument("--markdown", metavar="ROOM", help="show one room's result as Markdown")
    t = sub.add_parser("trace", help="what a source holds, per room")
    t.add_argument("src")
    t.add_argument("--source", default="auto")
    t.add_argument("--full", help="write all relations as JSON lines below this folder")
    for name in ("annotators", "sources"):
        sub.add_parser(name)
    s = sub.add_parser("schema")
    s.add_argument("annotator")
    x = sub.add_parser("taxonomy")
    x.add_argument("choice", nargs="?")
    n = sub.add_parser("new", help="a working annotator to start from")
    n.add_argument("name")
    n.add_argument("-o", "--out", default=".")
    v = sub.add_parser("validate", help="check a folder of records")
    v.add_argument("records")
    e = sub.add_parser("export", help="blind samples for human labels")
    e.add_argument("src")
    e.add_argument("--salt", required=True)
    e.add_argument("--context", type=int, default=8)
    e.add_argument("--codebook", default="ten_modes")
    e.add_argument("-o", "--out", required=True)
    c = sub.add_parser("compare", help="agreement of two labelled files")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("-o", "--out", help="write the report and the samples to adjudicate below this folder")
    f = sub.add_parser("finalize", help="gold labels of two raters and an adjudicator, back at their boards")
    for name in ("a", "b", "judged", "key"):
        f.add_argument(name)
    f.add_argument("-o", "--out", required=True)
    k = sub.add_parser("codebook", help="labels and their definitions, of a choice (by class with :groups)")
    k.add_argument("choice")
    return p


def _problems(rows) -> int:
    """Tells problems by kind; how many kinds there are."""
    told = rows.groupBy("problem").count().orderBy("problem").collect()
    for r in told:
        print(r["problem"], r["count"], file=sys.stderr)
    return len(told)


def main(argv: list[str] | None = None) -> int:
    """0 when done, 1 on a problem with the input, 2 when an output breaks its schema."""
    args = parser().parse_args(argv)
    if args.command in ("annotators", "sources"):
        for name, x in sorted((contract.registry() if args.command == "annotators" else contract.sources()).items()):
            print(name, "-", (x.__doc__ or "").strip().split("\n")[0])
        return 0
    if args.command == "taxonomy":
        print(json.dumps(taxonomy.CHOICES.get(args.choice) if args.choice else sorted(taxonomy.CHOICES), indent=1))
        return int(bool(args.choice) and args.choice not in taxonomy.CHOICES)
    if args.command == "new":
        if not contract.NAME.match(args.name):
            print("the name must be 2 to 41 lower-case letters, digits and _, starting with a letter", file=sys.stderr)
            return 1
        with open(f"{args.out}/{args.name}.py", "x", encoding="utf-8") as f:
            f.write(TEMPLATE.replace("NAME", args.name))
        return 0
    try:
        if args.command == "codebook":
            print(json.dumps(contract.codebook(args.choice.removesuffix(":groups"), args.choice.endswith(":groups")), indent=1, ensure_ascii=False))
            return 0
        if args.command == "schema":
            print(contract.get_annotator(args.annotator).schema)
            return 0
        spark = get_session()
        if args.command == "validate":
            bad = contract.validate_records(spark.read.json(args.records)).collect()
            for r in bad:
                print(r.problem, r.n)
            return int(bool(bad))
        if args.command in ("compare", "finalize"):
            rated = lambda path: ndjson(spark, path, audit.RATED).drop("path")
            a, b = rated(args.a), rated(args.b)
            if _problems(audit.check_labels(a).unionByName(audit.check_labels(b)).unionByName(audit.pair(a, b)[1])):
                return 1
            if args.command == "finalize":
                gold, problems = audit.finalize(a, b, rated(args.judged), ndjson(spark, args.key, audit.KEYED).select("sample_id", "trace_digest", "room", "seq"))
                if _problems(problems):
                    return 1
                write_jsonl(gold, args.out)
                return 0
            audit.compare(a, b).orderBy("label").show(1000, truncate=False)
            audit.compare_summary(a, b).show(truncate=False)
            if args.out:
                write_jsonl(audit.compare(a, b), f"{args.out}/report")
                write_jsonl(audit.compare_summary(a, b), f"{args.out}/summary")
                write_jsonl(a.join(audit.to_adjudicate(a, b).select("sample_id"), "sample_id", "left_semi").withColumn("labels", audit.F.array().cast("array<string>")).withColumn("uncertain", audit.F.array().cast("array<string>")), f"{args.out}/adjudicate")
            return 0
        board = contract.get_source(getattr(args, "source", "auto"))(spark, args.src)
        if args.command == "trace":
            B.summary(board).show(1000, truncate=False)
            for name in B.EMPTY if args.full else ():
                write_jsonl(getattr(board, name), f"{args.full}/{name}")
        elif args.command == "export":
            labels = [x["id"] for x in contract.codebook(args.codebook.removesuffix(":groups"), args.codebook.endswith(":groups"))["labels"]]
            rows = audit.export(board.posts, labels, args.salt, args.context, args.codebook)
            blind = rows.withColumn("labels", audit.F.array().cast("array<string>")).withColumn("uncertain", audit.F.array().cast("array<string>"))
            write_jsonl(blind.drop("room", "trace_digest").sort("sort_key").drop("sort_key"), f"{args.out}/blind")
            write_jsonl(rows.select("sample_id", "episode_id", "seq", "digest", "trace_digest", "room"), f"{args.out}/key")
        else:
            annotator = contract.get_annotator(args.annotator)
            out = annotator.annotate(board)
            problems = contract.validate_output(annotator, out)
            if problems:
                print(*problems, sep="\n", file=sys.stderr)
                return 2
            if args.markdown:
                show = {"modes_v1": views.modes, "kickstart": views.findings, "facts_v1": lambda found, room: views.facts(found, facts.seat_stats(board), room)}.get(args.annotator)
                if show is None:
                    print(f"{args.annotator} has no Markdown view", file=sys.stderr)
                    return 1
                print(show(out, args.markdown))
            elif args.out:
                write_jsonl(contract.records(annotator, board, out), args.out)
            else:
                out.show(1000, truncate=False)
        return 0
    except (ValueError, KeyError) as problem:
        print(problem, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
