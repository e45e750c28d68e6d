"""DuckDB SQL for the registered queries, written from the semantics.

RE2 has no look-ahead: a sentinel goes before the last white space of a run that text
follows, and the pattern never matches it. Merging is a recursive query over
distinct pieces whose symbols are hexadecimal strings; each step joins the two
neighbours of lowest rank, leftmost first.
"""

from __future__ import annotations

# White space, without and with the two line breaks, in RE2's spelling.
_NOT_BREAK = r"\x{09}\x{0B}\x{0C}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = _NOT_BREAK + r"\r\n"
_MARK = r"\x{E000}"

_UPPER, _LOWER = r"\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}", r"\p{Ll}\p{Lm}\p{Lo}\p{M}"
_ENDING = r"(?i:''s|''t|''re|''ve|''m|''ll|''d)?"


def _pattern(name: str) -> str:
    letters = r"\p{L}\p{M}" if name == "qwen_marks" else r"\p{L}"
    lead, other = rf"[^\r\n{letters}\p{{N}}{_MARK}]?", rf" ?[^{SPACE}{letters}\p{{N}}{_MARK}]+"
    short = r"''(?i:[sdmt]|ll|ve|re)"
    if name == "cl100k":
        return rf"{short}|{lead}{letters and f'[{letters}]'}+|\p{{N}}{{1,3}}|{other}[\r\n]*|[{SPACE}]+\z|[{SPACE}]*[\r\n]|[{SPACE}]+"
    if name == "o200k":
        words = rf"{lead}[{_UPPER}]*[{_LOWER}]+{_ENDING}|{lead}[{_UPPER}]+[{_LOWER}]*{_ENDING}"
        return rf"{words}|\p{{N}}{{1,3}}|{other}[\r\n/]*|[{SPACE}]*[\r\n]+|[{SPACE}]+"
    return rf"{short}|{lead}[{letters}]+|\p{{N}}|{other}[\r\n]*|[{SPACE}]*[\r\n]+|[{SPACE}]+"


def split(name: str, text: str = "text") -> str:
    """An expression: the list of pieces of a text expression."""
    marked = rf"regexp_replace({text}, '([{SPACE}])([{_NOT_BREAK}])([^{SPACE}])', '\1' || chr(57344) || '\2\3', 'g')"
    return f"regexp_extract_all({marked}, '{_pattern(name)}')"


def merged(texts: str, name: str, ranks: str) -> str:
    """CTEs over a query of (key, text): pieces(key, pos, piece), coded(piece, sym),
    vocab(h, r), toks(key, n, h, r): the tokens of each text in order, from 1."""
    return f"""
    src as materialized ({texts}),
    pieces as materialized (
        select key, unnest(range(1, len(ps) + 1)) as pos, unnest(ps) as piece
        from (select key, {split(name)} as ps from src)
    ),
    vocab as materialized (
        select lower(hex(from_base64(b))) as h, r
        from read_csv('{ranks}', delim=' ', header=false, quote='', escape='', columns={{'b': 'VARCHAR', 'r': 'BIGINT'}})
    ),
    st as (
        select piece, list_transform(range(0, octet_length(encode(piece))),
            lambda i: lower(hex(encode(piece)))[2 * i + 1 : 2 * i + 2]) as sym, 0 as step
        from (select distinct piece from pieces)
        union all
        select piece, sym[: k - 1] || [sym[k] || sym[k + 1]] || sym[k + 2 :], step + 1 from (
            select st.piece, any_value(st.sym) as sym, st.step, arg_min(u.i, v.r * 1000000 + u.i) as k
            from st, unnest(range(1, len(st.sym))) as u(i), vocab v
            where v.h = st.sym[u.i] || st.sym[u.i + 1]
            group by st.piece, st.step
        )
    ),
    coded as materialized (select piece, arg_max(sym, step) as sym from st group by piece),
    toks as materialized (
        select key, row_number() over (partition by key order by pos, j) as n, h, r from (
            select p.key, p.pos, unnest(range(1, len(c.sym) + 1)) as j, unnest(c.sym) as h
            from pieces p join coded c using (piece)
        ) join vocab using (h)
    )"""


def with_merged(texts: str, name: str, ranks: str, select: str) -> str:
    return f"with recursive {merged(texts, name, ranks)} {select}"
