"""The derived ledgers and the SQL that the queries are checked against."""
