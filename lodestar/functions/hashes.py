"""Hashes that DuckDB lacks, as SQL: the twins of queries that hash are built from them."""

from __future__ import annotations

# The primes of XXH64.
PRIMES = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
SEED = 42
P1, P2, P3, P4, P5 = (f"{p}::UHUGEINT" for p in PRIMES)
W = "18446744073709551615::UHUGEINT"


def low(x: str) -> str:
    """The low 64 bits."""
    return f"(({x}) & {W})"


def turn(x: str, r: int) -> str:
    """Turned left by r bits."""
    return f"(((({x}) << {r}) & {W}) | (({x}) >> {64 - r}))"


def step(v: str, lane: str) -> str:
    """One round of a lane."""
    return low(f"{turn(low(f'{v} + {low(f'{lane} * {P2}')}'), 31)} * {P1}")


def number(h: str) -> str:
    """Hex digits of bytes, the least first, as a number."""
    return f"CAST(CAST('0x' || array_to_string(list_reverse(regexp_extract_all({h}, '..')), '') AS UBIGINT) AS UHUGEINT)"


def fold(lists: str, body: str, start: str) -> str:
    return f"list_reduce({lists}, lambda h, x: {body}, {start})"


def xxh64(terms: str) -> str:
    """SQL for (term, h): the 64-bit XXH64, seed 42, of the terms' UTF-8."""
    lane = lambda j: f"list_transform(range(n // 32), lambda i: {number(f'substr(hx, CAST(64 * i + {16 * j + 1} AS BIGINT), 16)')})"
    starts = [str((SEED + PRIMES[0] + PRIMES[1]) % 2**64), str((SEED + PRIMES[1]) % 2**64), str(SEED), str((SEED - PRIMES[0]) % 2**64)]
    vs = ", ".join(f"{fold(lane(j), step('h', 'x'), s + '::UHUGEINT')} AS v{j}" for j, s in enumerate(starts))
    wide = low(" + ".join(turn(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18))))
    for j in range(4):
        wide = low(f"{low(f'xor({wide}, {step('0::UHUGEINT', f'v{j}')}) * {P1}')} + {P4}")
    eight = fold(f"list_transform(range(n % 32 // 8), lambda i: {number('substr(hx, CAST(n // 32 * 64 + 16 * i + 1 AS BIGINT), 16)')})", low(f"{low(f'{turn(f'xor(h, {step('0::UHUGEINT', 'x')})', 27)} * {P1}')} + {P4}"), "b")
    four = low(f"{low(f'{turn(f'xor(c, {low(f'{number('substr(hx, n // 8 * 16 + 1, 8)')} * {P1}')})', 23)} * {P2}')} + {P3}")
    ones = fold(f"list_transform(range(n % 4), lambda i: {number('substr(hx, CAST(n // 4 * 8 + 2 * i + 1 AS BIGINT), 2)')})", low(f"{turn(f'xor(h, {low(f'x * {P5}')})', 11)} * {P1}"), "d")
    return f"""SELECT term, xor(g, g >> 32) AS h FROM (SELECT term, {low(f'xor(f, f >> 29) * {P3}')} AS g FROM (SELECT term, {low(f'xor(e, e >> 33) * {P2}')} AS f FROM (SELECT term, {ones} AS e FROM (
SELECT *, CASE WHEN n % 8 >= 4 THEN {four} ELSE c END AS d FROM (SELECT *, {eight} AS c FROM (SELECT *, CASE WHEN n >= 32 THEN {low(f'{wide} + n::UHUGEINT')} ELSE {low(f'{SEED}::UHUGEINT + {P5} + n::UHUGEINT')} END AS b FROM (
SELECT *, {vs} FROM (SELECT term, hex(encode(term)) AS hx, strlen(term) AS n FROM {terms}))))))))"""


def crc32(column: str, source: str, keep: str) -> str:
    """SQL for (keep, crc): CRC-32 of the UTF-8 of a text column, by the table of the reflected polynomial."""
    return f"""WITH crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b)) AS t),
crc_bytes AS (SELECT {keep}, list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM {source})
SELECT {keep}, xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS crc FROM crc_bytes, crc_table"""
