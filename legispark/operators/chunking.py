"""Structure-aware chunks. Lines are classified natively; each document's lines then meet in one group, where packing is a fold."""

from __future__ import annotations

import json
import re
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legispark.operators.structure import CONTAINERS, TABLE_KINDS, TABLE_MARKERS, classify, line_tokens
from legispark.operators.tree import read_lines

_WORD = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+")
SCHEMA = "chunk_id string, parent_id string, chunk_type string, is_indexable boolean, ordinal int, label string, path string, context string, text string, tokens int"


@dataclass(frozen=True)
class ChunkPolicy:
    target: int = 600
    most: int = 1200
    least_tail: int = 80
    overlap_share: float = 0.125
    overlap_cap: float = 0.2


def approximate_tokens(text: str) -> int:
    return len(_WORD.findall(text))


_counter: Callable[[str], int] = approximate_tokens


def use_counter(counter: Callable[[str], int] | None = None) -> None:
    """Count tokens of chunks with a model's counter (``functions/tokenizers.py``); by default words and marks count."""
    global _counter
    _counter = counter or approximate_tokens


def count_tokens(text: str) -> int:
    return _counter(text)


def split_to_limit(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` tokens: whole sentences where they fit, else words, else parts of words."""
    out: list[str] = []
    current: list[str] = []
    size = 0
    for sentence in _SENTENCE.split(text):
        n = count_tokens(sentence)
        pieces = [(sentence, n)] if n <= most else [(w, count_tokens(w)) for w in sentence.split()]
        for piece, n in pieces:
            if n > most:
                units = _WORD.findall(piece)
                if current:
                    out.append(" ".join(current))
                    current, size = [], 0
                out += ["".join(units[k : k + most]) for k in range(0, n, most)]
                continue
            if current and size + n > most:
                out.append(" ".join(current))
                current, size = [], 0
            current.append(piece)
            size += n
    return [*out, " ".join(current)] if current else out


def pack(units: list[tuple[str, str]], policy: ChunkPolicy) -> list[tuple[str, str, str]]:
    """(first label, last label, text) of consecutive units: a group closes at the target, never exceeds the most; a small tail joins the group before it if it fits."""
    groups: list[list[tuple[str, str, int]]] = []
    size, open_ = 0, False
    for label, text in units:
        for piece in split_to_limit(text, policy.most) if count_tokens(text) > policy.most else [text]:
            n = count_tokens(piece)
            if not open_ or size + n > policy.most:
                groups.append([])
                size, open_ = 0, True
            groups[-1].append((label, piece, n))
            size += n
            open_ = size < policy.target
    if len(groups) > 1:
        tail = sum(n for _, _, n in groups[-1])
        if tail < policy.least_tail and tail + sum(n for _, _, n in groups[-2]) <= policy.most:
            groups[-2:] = [groups[-2] + groups[-1]]
    return [(g[0][0], g[-1][0], "\n".join(t for _, t, _ in g)) for g in groups]


def table_of(lines: list[str]) -> tuple[list[str], list[list[str]]]:
    """(headers, rows) of the marker lines of one table; lines that are no JSON array are left to the audit of tables."""
    headers: list[str] = []
    rows: list[list[str]] = []
    for line in lines:
        for kind in ("table_headers", "table_row"):
            if line.startswith(TABLE_MARKERS[kind]):
                try:
                    values = json.loads(line[len(TABLE_MARKERS[kind]) :].strip())
                except ValueError:
                    continue
                if isinstance(values, list):
                    cells = [" ".join(str(v).split()) for v in values]
                    if kind == "table_row":
                        rows.append(cells)
                    else:
                        headers = cells
    return headers, rows


def table_blocks(headers: list[str], rows: list[list[str]], policy: ChunkPolicy, name: str = "Bảng dữ liệu") -> list[tuple[str, str]]:
    """(context, text): rows in blocks, each under the headers. Headers of half a block or more get blocks of their own, and the rows a short name instead."""
    head = " | ".join(h for h in headers if h)
    units = [("", u) for r in rows if (u := " | ".join(c for c in r if c))]
    if not units:
        return [("", t) for t in split_to_limit(head, policy.most)] if head else []
    out: list[tuple[str, str]] = []
    if head and count_tokens(head) >= policy.most // 2:
        title = f"{name}: tiêu đề và cấu trúc cột"
        out += [(title, t) for t in split_to_limit(head, max(1, policy.most - count_tokens(title)))]
        head = name
    room = max(1, policy.most - count_tokens(head))
    return out + [(head, t) for _, _, t in pack(units, replace(policy, target=max(1, min(policy.target, room)), most=room, least_tail=0))]


def split_tables(lines: list[tuple[str, str]]) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """Runs of lines (line, kind) that are a table, and runs that are not. A table ends at its end mark, or with the lines."""
    run: list[tuple[str, str]] = []
    inside = False
    for line in lines:
        if not inside and line[1] == "table_start":
            if run:
                yield False, run
            run, inside = [], True
        run.append(line)
        if inside and line[1] == "table_end":
            yield True, run
            run, inside = [], False
    if run:
        yield inside, run


def by_heading(lines: list[tuple[str, str]], headings: tuple[str, ...] = ("free_heading", *CONTAINERS)) -> list[tuple[str, list[tuple[str, str]]]]:
    """(heading, lines): a heading opens a group, which it belongs to."""
    groups: list[tuple[str, list[tuple[str, str]]]] = []
    for line, kind in lines:
        if kind in headings or not groups:
            groups.append((line if kind in headings else "", []))
        groups[-1][1].append((line, kind))
    return groups


def pack_blocks(lines: list[tuple[str, str]], policy: ChunkPolicy, context: str = "", grouped: bool = False) -> Iterator[tuple[str, str, str]]:
    """(kind, context, text) of lines: tables by rows under their headers, other lines packed, by heading if ``grouped``.

    The context of a block is what stands above it and not in it: ``context``, its group's heading, its table's
    headers. Context and text together keep to the policy.
    """
    above = context
    tables = 0
    for is_table, run in split_tables(lines):
        if is_table:
            tables += 1
            room = max(1, policy.most - count_tokens(above))
            headers, rows = table_of([line for line, _ in run])
            loose = [line for line, kind in run if kind not in TABLE_KINDS]
            for head, text in table_blocks(headers, rows, replace(policy, most=room, target=min(policy.target, room)), f"Bảng {tables}"):
                yield "table", "\n".join(x for x in (above, head) if x), text
            run = [(line, "text") for line in loose]
        for heading, group in by_heading(run) if grouped else [("", run)] if run else []:
            room = max(1, policy.most - count_tokens(above) - count_tokens(heading))
            for n, (_, _, text) in enumerate(pack([("", line) for line, _ in group], replace(policy, most=room, target=max(1, min(policy.target, room))))):
                yield "text", "\n".join(x for x in (above, heading if n else "") if x), text


def overlap_tail(text: str, target: int, most: int) -> str:
    """Whole sentences from the end of a text, about ``target`` tokens and at most ``most``."""
    picked: list[str] = []
    size = 0
    for s in reversed([s for line in text.splitlines() for s in _SENTENCE.split(line.strip()) if s.strip()]):
        n = count_tokens(s)
        if n > most or (picked and size + n > most):
            break
        picked.append(s)
        size += n
        if size >= target:
            break
    return "\n".join(reversed(picked))


def _range(first: str, last: str) -> str | None:
    return (first if first == last else f"{first}-{last}") or None


Line = namedtuple("Line", ["row", "doc_id", "line", "kind", *CONTAINERS, "article"])


def _chunk(rows: list[Line], policy: ChunkPolicy) -> Iterator[dict]:
    """The chunks of one document; its lines carry kind and containment."""
    doc_id = rows[0].doc_id
    used: dict[str, int] = {}

    def make(kind: str, text: str, parts: tuple, parent: str | None = None, indexable: bool = True, label: str | None = None, path: str = "", context: str = "") -> dict:
        base = "::".join(str(x) for x in (doc_id, *parts) if x not in (None, ""))
        used[base] = used.get(base, 0) + 1
        ident = base if used[base] == 1 else f"{base}::{used[base]}"
        return {"chunk_id": ident, "parent_id": parent, "chunk_type": kind, "is_indexable": indexable, "label": label, "path": path, "context": context, "text": text, "tokens": count_tokens(text)}

    def items(lines: list, kind: str, pattern: str) -> tuple[list[str], list[tuple[str, str]]]:
        lead: list[str] = []
        found: list[tuple[str, list[str]]] = []
        for line, k in lines:
            if k == kind:
                found.append((re.match(pattern, line, re.I)[1], [line]))
            elif found:
                found[-1][1].append(line)
            else:
                lead.append(line)
        return lead, [(label, "\n".join(x)) for label, x in found]

    def blocks(lines: list, kind: str, parts: tuple, path: str, parent: str | None = None, context: str = "", grouped: bool = False, start: int = 0) -> Iterator[dict]:
        for n, (what, above, text) in enumerate(pack_blocks(lines, policy, context, grouped), start):
            yield make("table_block" if what == "table" else kind, text, (*parts, "table" if what == "table" else kind, n), parent, path=path, context=above)

    def appendix(lines: list[tuple[str, str, str | None]], path: str) -> Iterator[dict]:
        """A parent of the whole, then its articles, then its tables and other lines under its heading."""
        heading = lines[0][0]
        parent = make("appendix_parent", "\n".join(line for line, _, _ in lines), (path, "appendix"), indexable=False, path=path)
        yield parent
        articles: list[tuple[str, list[tuple[str, str]]]] = []
        regular: list[tuple[str, str]] = []
        for line, kind, label in lines[1:]:
            if kind == "article":
                articles.append((label or "", []))
            (articles[-1][1] if label and articles and articles[-1][0] == label else regular).append((line, kind))
        for label, own in articles:
            for chunk in article(own, label, path):
                yield chunk | {"parent_id": chunk["parent_id"] or parent["chunk_id"]}
        # The heading stands in the first block and above the others.
        if not regular:
            yield make("appendix_block", heading, (path, "appendix_block", 0), parent["chunk_id"], path=path)
            return
        yield from blocks([(heading, "heading")], "appendix_block", (path,), path, parent["chunk_id"])
        yield from blocks(regular, "appendix_block", (path,), path, parent["chunk_id"], heading if count_tokens(heading) * 2 < policy.most else "", True, 1)

    def article(lines: list, label: str, path: str) -> Iterator[dict]:
        whole = "\n".join(line for line, _ in lines)
        if count_tokens(whole) <= policy.most:
            yield make("article", whole, (path, "article", label), label=label, path=path)
            return
        parent = make("article_parent", whole, (path, "article", label), indexable=False, label=label, path=path)
        yield parent
        lead, clauses = items(lines, "numbered_item", r"\s*(\d{1,3}[a-zđ]?)[.)]")
        kind = "clause"
        if not clauses:
            lead, clauses = items(lines, "lettered_item", r"\s*([a-zđ]\d*)[.)]")
            kind = "point"
        if not clauses:
            for n, text in enumerate(split_to_limit(whole, policy.target)):
                yield make("article_fragment", text, (parent["chunk_id"].split("::", 1)[1], "fragment", n), parent["chunk_id"], label=label, path=path)
            return
        if lead:
            for n, text in enumerate(split_to_limit("\n".join(lead), policy.most)):
                yield make("article_lead_fragment", text, (parent["chunk_id"].split("::", 1)[1], "lead", n), parent["chunk_id"], label=label, path=path)
        for first, last, text in pack(clauses, policy):
            name = _range(first, last)
            yield make(kind if first == last else f"{kind}_group", text, (parent["chunk_id"].split("::", 1)[1], kind, name), parent["chunk_id"], label=name, path=path)

    has_articles = any(r.article for r in rows)
    groups: list[tuple[tuple, list]] = []
    for r in rows:
        path = "/".join(f"{c}={getattr(r, c)}" for c in CONTAINERS if getattr(r, c))
        if r.appendix:
            section: tuple = ("appendix", f"appendix={r.appendix}", "")
            opens = r.kind == "appendix"
        else:
            section = ("article" if r.article else "container" if path else "plain", path, r.article or "")
            opens = r.kind == "article"
        if not groups or groups[-1][0] != section or opens:
            groups.append((section, []))
        groups[-1][1].append((r.line, r.kind, r.article))
    kinds = {r.kind for r in rows}
    for (section, path, label), found in groups:
        lines = [(line, kind) for line, kind, _ in found]
        if section == "article":
            yield from article(lines, label, path)
        elif section == "appendix":
            yield from appendix(found, path)
        elif section == "container":
            yield from blocks(lines, "hierarchical_block", (path,), path, grouped=True)
        else:
            structured = bool(kinds & {"free_heading", "bullet", "numbered_item", "lettered_item"})
            kind = "preamble" if has_articles and (section, path, label) == groups[0][0] else "residual_block" if has_articles else "structured_block" if structured else "freeform_block"
            yield from blocks(lines, kind, (), path, grouped=kind == "structured_block")


def chunk_documents(docs: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """Chunks of documents (doc_id, text), by their structure as ``tree.read_lines`` has it.

    A document is a row, whatever its id: rows without one, or with one that others have, stay apart, and the id is carried
    as it is. Every line is in the text of some indexable chunk (tables by their cells); context and text of a chunk
    together do not exceed the most tokens.
    """
    read = read_lines(docs)
    # A table's lines keep their marks; a title that a heading has taken opens no group of its own.
    kind = F.when(F.col("inferred"), "appendix").when(F.col("taken"), "title").otherwise(F.col("mark"))
    places = [F.col(c)["label"].alias(c) for c in (*CONTAINERS, "article")]
    lines = read.select("row", "doc_id", "line", kind.alias("kind"), *places, "line_no").sortWithinPartitions("row", "line_no").select(*Line._fields)
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = [x.split() for x in SCHEMA.split(", ")]

    def table(found: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        ids = pa.array([c["doc_id"] for c in found], id_type)
        return pa.RecordBatch.from_arrays([ids, *(pa.array([c[n] for c in found], types[t]) for n, t in columns)], names=["doc_id", *(n for n, _ in columns)])

    def chunks_of(doc: list[Line]) -> list[dict]:
        return [c | {"doc_id": doc[0].doc_id, "ordinal": k} for k, c in enumerate(_chunk(doc, policy))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: list[Line] = []
        out: list[dict] = []
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc and doc[0].row != row[0]:
                    out += chunks_of(doc)
                    doc = []
                    if len(out) > 2000:
                        yield table(out, id_type)
                        out = []
                doc.append(Line(*row))
        if doc:
            yield table(out + chunks_of(doc), id_type)

    return lines.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def semantic_overlap(chunks: DataFrame, policy: ChunkPolicy = ChunkPolicy(), least_source: int = 600, least: int = 60) -> DataFrame:
    """Adds overlap_from and overlap_text: the tail of the previous chunk of the same parent and type, if that is long enough. The text itself is unchanged."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "parent_id", "chunk_type").orderBy("ordinal")
    x = chunks.filter("is_indexable").withColumns({"_text": F.lag("text").over(w), "_n": F.lag("tokens").over(w), "overlap_from": F.lag("chunk_id").over(w)})

    @F.pandas_udf("string")
    def tail(text: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([overlap_tail(t, max(least, int(k * policy.overlap_share)), max(least, int(k * policy.overlap_cap))) if t is not None and k >= least_source else None for t, k in zip(text, n.fillna(0), strict=True)])

    x = x.withColumn("overlap_text", F.nullif(tail("_text", "_n"), F.lit("")))
    return x.withColumn("overlap_from", F.when(F.col("overlap_text").isNotNull(), F.col("overlap_from"))).drop("_text", "_n")


def uncovered_lines(docs: DataFrame, chunks: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """(doc_id, line_no, line) of lines that no indexable chunk of their document holds: the guard of what was chunked.

    Lines longer than a chunk may be are cut into pieces, and tables are kept by their cells; both are left out here.
    """
    from legispark.functions.text import token_count

    lines = classify(line_tokens(docs.select("doc_id", "text"))).filter(~F.col("kind").isin(*TABLE_KINDS))
    held = chunks.filter("is_indexable").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).distinct()
    return lines.filter(token_count(F.col("line")) <= policy.target).join(held, ["doc_id", "line"], "left_anti").select("doc_id", "line_no", "line")
