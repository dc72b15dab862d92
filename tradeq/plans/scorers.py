"""The scorers of ``functions.text`` as SQL expressions for the checks."""

from __future__ import annotations


def _percent(a: str, b: str) -> str:
    longest = f"greatest(length({a}),length({b}))"
    return f"CASE WHEN {longest}=0 THEN 0 ELSE CAST(round_even(100.0::DOUBLE*({longest}-levenshtein({a},{b}))/{longest},0) AS INT) END"


ratio = _percent


def ninety_five(x: str) -> str:
    return f"CAST(round_even(95*({x})/100.0::DOUBLE,0) AS INT)"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c},'\\s+'), lambda w: w<>'')"


def sorted_words(c: str) -> str:
    return f"array_to_string(list_sort({words(c)}),' ')"


def word_set(c: str) -> str:
    return f"list_sort(list_distinct({words(c)}))"


def token_set(sa: str, sb: str) -> str:
    shared = f"array_to_string(list_filter({sa}, lambda w: list_contains({sb},w)),' ')"
    a = f"trim(concat_ws(' ',{shared},array_to_string(list_filter({sa}, lambda w: NOT list_contains({sb},w)),' ')))"
    b = f"trim(concat_ws(' ',{shared},array_to_string(list_filter({sb}, lambda w: NOT list_contains({sa},w)),' ')))"
    return f"greatest({ratio(shared, a)},{ratio(shared, b)},{ratio(a, b)})"


def weighted(a: str, b: str) -> str:
    return (
        f"greatest({ratio(a, b)},{ninety_five(ratio(sorted_words(a), sorted_words(b)))},"
        f"{ninety_five(token_set(word_set(a), word_set(b)))})"
    )


def partial(a: str, b: str) -> str:
    short = f"(CASE WHEN length({a})<=length({b}) THEN {a} ELSE {b} END)"
    long = f"(CASE WHEN length({a})<=length({b}) THEN {b} ELSE {a} END)"
    n = f"length({short})"
    window = f"substr({long}, CAST(i AS INT), CAST({n} AS INT))"
    return f"list_max(list_transform(range(1, length({long})-{n}+2), lambda i: {ratio(window, short)}))"


def strings(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
