"""``python -m pagemill INPUT``: extracts pages of a file, a folder, standard input, an address or a Parquet table."""

from __future__ import annotations

import argparse
import json
import sys

from .functions.dom import trim
from .functions.text import strip_html_tags
from .operators.extract import extract, extract_page
from .operators.pipeline import Options
from .sources import files, web


def options_of(args: argparse.Namespace) -> Options:
    return Options(
        url=args.url,
        content_selector=args.selector,
        debug=args.debug,
        separate_markdown=args.format == "markdown",
        remove_images=args.no_images,
        include_replies=not args.no_replies,
        remove_exact_selectors=not args.no_exact_selectors,
        remove_partial_selectors=not args.no_partial_selectors,
        remove_hidden_elements=not args.no_hidden_removal,
        remove_low_scoring=not args.no_scoring,
        remove_content_patterns=not args.no_content_patterns,
        standardize=not args.no_standardize,
    )


def shown(page: dict, form: str) -> str:
    if form == "html":
        return page["content"]
    if form == "markdown":
        return page["content_markdown"] if page["content_markdown"] is not None else page["content"]
    if form == "text":
        return trim(strip_html_tags(page["content"]))
    schema = page["schema_org_data"]
    kept = {k: v for k, v in page.items() if v is not None and (k != "keywords" or v)}
    return json.dumps(kept | {"schema_org_data": None if schema is None else json.loads(schema)}, ensure_ascii=False, indent=2)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    p.add_argument("input", nargs="?", default="-", help="file, folder of Parquet pages, http(s) address, or - for standard input")
    p.add_argument("-u", "--url", help="address of the page")
    p.add_argument("-s", "--selector", help="CSS selector of the content")
    p.add_argument("-f", "--format", choices=("json", "html", "text", "markdown"), default="json")
    p.add_argument("-d", "--debug", action="store_true")
    p.add_argument("-o", "--output", help="for a table of pages: where to write")
    for name in ("images", "replies", "exact-selectors", "partial-selectors", "hidden-removal", "scoring", "content-patterns", "standardize"):
        p.add_argument(f"--no-{name}", action="store_true")
    args = p.parse_args(argv)
    if args.output:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        files.write_results(extract(files.read_pages(spark, args.input), options_of(args)), args.output, args.format)
        return 0
    try:
        if args.input.startswith(("http://", "https://")):
            args.url = args.url or args.input
            html = web.fetch_page(args.input)
        elif args.input == "-":
            html = sys.stdin.read()
        else:
            with open(args.input, encoding="utf-8", newline="") as f:
                html = f.read()
    except (OSError, UnicodeDecodeError, web.FetchError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    try:
        print(shown(extract_page(html, args.url, options_of(args)), args.format))
    except BrokenPipeError:
        sys.stderr.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
