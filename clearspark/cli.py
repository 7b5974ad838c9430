"""spark-submit clearspark/cli.py [text] --words words.txt [--grams grams.txt] [--level ...] [--json]: undo the disguises of one text, or of stdin."""

from __future__ import annotations

import argparse
import json
import sys

from clearspark import sources
from clearspark.kernel.engine import LEVELS, Unmasker
from clearspark.kernel.lexicon import Resources
from clearspark.operators.unmask import STEP
from clearspark.session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("text", nargs="?", help="the text; stdin if left out")
    parser.add_argument("--words", required=True, help="a word a line")
    parser.add_argument("--grams", help="letter sequences: a line that ends with the total, then sequence, tab, count")
    parser.add_argument("--strictness", "--level", dest="level", choices=LEVELS, default="conservative")
    parser.add_argument("--json", action="store_true", help="the text and its steps as JSON")
    args = parser.parse_args(argv)
    text = args.text if args.text is not None else sys.stdin.read()
    spark = local_session()
    words = frozenset(r.word for r in sources.word_list(spark, args.words).collect())
    grams = sources.gram_table(spark, args.grams).collect() if args.grams else []
    resources = Resources(words, {r.gram: r.cnt for r in grams}, grams[0].total if grams else 0)
    new, steps = Unmasker(resources, args.level)(text)
    if args.json:
        print(json.dumps({"text": new, "steps": [dict(zip(STEP.names, s, strict=True)) for s in steps]}, ensure_ascii=False))
    else:
        print(new, end="" if new.endswith("\n") else "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
