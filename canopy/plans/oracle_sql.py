"""DuckDB oracle building blocks.

The oracle sees only the raw driver tables, so every stand-in of
:mod:`canopy.sources.standins` is repeated here as a CTE, and the Spark
column functions have SQL twins.  ``with_ctes(body, *names)`` prepends the
needed CTEs (dependencies resolved, each once).
"""

from __future__ import annotations

from canopy.functions.text import MODEL_VERSION


# ------------------------------------------------------------ expressions

def segs(p: str) -> str:
    return f"string_split({p}, '/')"


def basename(p: str) -> str:
    return f"{segs(p)}[-1]"


def dirname(p: str) -> str:
    return (f"(CASE WHEN len({segs(p)}) <= 1 THEN '' "
            f"ELSE array_to_string({segs(p)}[1:len({segs(p)}) - 1], '/') END)")


def ancestors(p: str) -> str:
    return f"list_transform(range(1, len({segs(p)})), lambda i: array_to_string({segs(p)}[1:i], '/'))"


def prefixes(p: str) -> str:
    return f"list_transform(range(1, len({segs(p)}) + 1), lambda i: array_to_string({segs(p)}[1:i], '/'))"


def dir_id(p: str) -> str:
    return f"substring(sha256({p}), 1, 16)"


def parent_id(p: str) -> str:
    return f"(CASE WHEN instr({p}, '/') = 0 THEN NULL ELSE {dir_id(dirname(p))} END)"


def extension(p: str) -> str:
    return f"lower(regexp_extract({basename(p)}, '^.+(\\.[^.]*)$', 1))"


def language(p: str) -> str:
    e = extension(p)
    return (f"(CASE WHEN {e} IN ('.ts', '.tsx', '.js', '.jsx') THEN 'typescript' "
            f"WHEN {e} = '.py' THEN 'python' ELSE 'plain' END)")


def content_hash(t: str) -> str:
    return f"sha256({t} || '{MODEL_VERSION}')"


def lines(t: str) -> str:
    return f"string_split({t}, chr(10))"


def loc(t: str) -> str:
    return f"CAST(len({lines(t)}) AS INTEGER)"


def dot(a: str, b: str) -> str:
    """Sequential left fold in double: bit-equal to Spark's ``aggregate``."""
    return (f"(CASE WHEN len({a}) <> len({b}) THEN NULL WHEN len({a}) = 0 THEN 0.0::DOUBLE ELSE "
            f"list_reduce(list_transform(range(1, len({a}) + 1), "
            f"lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda x, y: x + y) END)")


def norm_sq(a: str) -> str:
    return (f"(CASE WHEN len({a}) = 0 THEN 0.0::DOUBLE ELSE list_reduce(list_transform({a}, "
            f"lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda x, y: x + y) END)")


def cosine(a: str, b: str) -> str:
    """Lenient cosine (0 on mismatch / zero norm)."""
    return (f"(CASE WHEN len({a}) <> len({b}) OR {norm_sq(a)} = 0 OR {norm_sq(b)} = 0 THEN 0.0 "
            f"ELSE {dot(a, b)} / (sqrt({norm_sq(a)}) * sqrt({norm_sq(b)})) END)")


def normalize(a: str) -> str:
    n = f"sqrt({norm_sq(a)})"
    return (f"(CASE WHEN {n} = 0 THEN {a} ELSE "
            f"list_transform({a}, lambda x: CAST(CAST(x AS DOUBLE) / {n} AS FLOAT)) END)")


def item(ls: str, i: int) -> str:
    return item_of(f"{ls}[{i}]")


def item_of(line: str) -> str:
    return (f"{{'name': nullif(regexp_extract({line}, '^([^ ]+)', 1), ''), 'loc': 1, "
            f"'summary': nullif({line}, '')}}")


def summary_parts(t: str) -> str:
    """title, summary, functions, classes, loc of a whole text, as SELECT items."""
    ls = lines(t)
    return (f"{ls}[1] AS title, array_to_string(list_transform({ls}, lambda x: regexp_extract(x, '^[^.!?]*[.!?]?')), ' ') AS summary, "
            f"list_transform({ls}[2:], lambda x: {item_of('x')}) AS functions, [{item(ls, -1)}] AS classes, {loc(t)} AS loc")


def r6(x: str) -> str:
    """Round to 6 places; ``+ 0.0`` turns a rounded -0.0 into 0.0 as Spark does."""
    return f"(round({x}, 6) + 0.0)"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "[" + ", ".join(sql_str(x) for x in xs) + "]"


# ------------------------------------------------------------------- CTEs

_EXT = "(CASE lang WHEN 'en' THEN '.ts' WHEN 'fr' THEN '.py' WHEN 'de' THEN '.md' ELSE '.bin' END)"
_DEEP = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')"

CTES: dict[str, tuple[str, list[str]]] = {
    "files": (f"""SELECT doc_id AS file_id,
        source || '/' || lang || '/doc' || CAST(doc_id AS VARCHAR) || {_EXT} AS path,
        'doc' || CAST(doc_id AS VARCHAR) || {_EXT} AS name, text,
        CAST(strlen(text) AS BIGINT) AS size, lang FROM documents""", []),
    "files_deep": (f"""SELECT page_id AS file_id, {_DEEP} AS path,
        string_split({_DEEP}, '/')[-1] AS name, html AS text,
        CAST(strlen(html) AS BIGINT) AS size FROM pages""", []),
    "keyed": (f"SELECT file_id, path, text, {content_hash('text')} AS hash FROM files", ["files"]),
    "summaries": (f"""SELECT hash, {language('path')} AS language, path, text,
        {summary_parts('text')}
        FROM (SELECT hash, arg_min(path, file_id) AS path, arg_min(text, file_id) AS text
              FROM keyed GROUP BY hash)""", ["keyed"]),
    "cache": ("SELECT DISTINCT hash FROM keyed WHERE file_id % 3 = 0", ["keyed"]),
    "node_embeddings": ("""SELECT CAST(vec_id AS VARCHAR) AS id,
        CASE WHEN vec_id % 5 = 0 THEN 'model_b' ELSE 'model_a' END AS model,
        CAST(len(embedding) AS INTEGER) AS dim, embedding AS vector, vec_id, label FROM embeddings""", []),
    "raw_vectors": ("""SELECT CAST(vec_id AS VARCHAR) AS id,
        CASE WHEN vec_id % 97 = 0 THEN list_transform(embedding, lambda x: CAST(0.0 AS FLOAT))
             ELSE list_transform(embedding, lambda x: CAST(x * CAST(vec_id % 7 + 1 AS FLOAT) AS FLOAT)) END AS vector, vec_id, label
        FROM embeddings""", []),
    "domains": ("""SELECT CAST(label AS INTEGER) AS domain_id, 'domain-' || CAST(label + 1 AS VARCHAR) AS title,
        'Topic area ' || CAST(label AS VARCHAR) AS description, arg_min(embedding, vec_id) AS vector
        FROM embeddings GROUP BY label""", []),
    "subtopics": ("""SELECT domain_id, pos, 'sub-' || CAST(pos AS VARCHAR) AS title,
        'Subtopic ' || CAST(pos AS VARCHAR) || ' of domain ' || CAST(domain_id AS VARCHAR) AS description
        FROM domains, (SELECT unnest([0, 1, 2]) AS pos)""", ["domains"]),
    "prices": ("""SELECT model, CAST(i AS DOUBLE) AS input_price, CAST(o AS DOUBLE) AS output_price FROM
        (VALUES ('model_a', 1.5, 7.0), ('model_b', 4.25, 11.5), ('model_c', 0.35, 0.9)) AS t(model, i, o)""", []),
}


MATERIALIZE: set[str] = set()


def add_cte(name: str, sql: str, deps: list[str], materialize: bool = False) -> None:
    CTES[name] = (sql, deps)
    if materialize:
        MATERIALIZE.add(name)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in MATERIALIZE else ''}({CTES[n][0]})" for n in order) + "\n" + body
