"""CRC-32 in DuckDB's SQL, which has no function for it."""

#: Two common table expressions, to stand first in a WITH RECURSIVE: one row with the table of bytes' remainders.
CRC_TABLE = """crc_steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS crc_tab FROM crc_steps WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes, in a query that has crc_table in its FROM."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda a, b: xor(crc_tab[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295)"
