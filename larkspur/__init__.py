"""A relational analytics engine on Spark: tables, queries, transactions, statistics, column-store loading."""
