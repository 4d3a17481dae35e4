"""Names of added columns that clash with those that operators use inside."""

CLASHES = ["bucket", "key", "rep", "comp", "node", "bands", "text_sha256", "slot", "count", "n", "a", "b", "low", "high", "position", "start", "end", "digest", "rules", "spans", "rank", "block", "name", "hash", "chunk", "place"]
