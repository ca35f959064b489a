"""Command line: encode, decode, encode-diff and decode-diff of single state files, and table definitions from schemas.

    python -m tidemark.sources.cli encode schema.yml -t Type -i state.json -o state.bin
    python -m tidemark.sources.cli decode-diff schema.yml -t Type --old old.json --diff change.bin
    python -m tidemark.sources.cli generate schema.yml
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tidemark.functions.jsonform import parse, render
from tidemark.functions.schema import Object, Ref, SchemaError, parse_schema, to_ddl
from tidemark.functions.wire import Codec


def _read(path: str | None) -> bytes:
    return Path(path).read_bytes() if path and path != "-" else sys.stdin.buffer.read()


def _write(path: str | None, data: bytes) -> None:
    if path and path != "-":
        Path(path).write_bytes(data)
    else:
        sys.stdout.buffer.write(data)
        sys.stdout.buffer.flush()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidemark")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("encode", "decode", "encode-diff", "decode-diff", "generate"):
        p = commands.add_parser(name)
        p.add_argument("schema")
        p.add_argument("-o", "--output")
        if name != "generate":
            p.add_argument("-t", "--type", required=True)
        if name in ("encode", "decode"):
            p.add_argument("-i", "--input")
        if name.endswith("diff"):
            p.add_argument("--old", required=True)
            p.add_argument("--new" if name == "encode-diff" else "--diff", required=True)
    a = top.parse_args(argv)
    try:
        schema = parse_schema(Path(a.schema).read_text())
        if a.command == "generate":
            lines = [f"CREATE TABLE {name} ({to_ddl(schema, name)});" for name, t in schema.named.items() if isinstance(t, Object)]
            _write(a.output, ("\n".join(lines) + "\n").encode())
            return 0
        schema.root(a.type)
        codec, root = Codec(schema, a.type), Ref(a.type)

        def state(path: str | None):
            return parse(schema, root, json.loads(_read(path)))

        def text(value) -> bytes:
            return (json.dumps(render(schema, root, value), indent=2, ensure_ascii=False) + "\n").encode()

        match a.command:
            case "encode":
                _write(a.output, codec.encode(state(a.input)))
            case "decode":
                _write(a.output, text(codec.decode(_read(a.input))))
            case "encode-diff":
                _write(a.output, codec.encode_diff(state(a.old), state(a.new)))
            case "decode-diff":
                _write(a.output, text(codec.decode_diff(state(a.old), _read(a.diff))))
    except (OSError, ValueError, SchemaError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
