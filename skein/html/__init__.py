"""HTML to articles: runs inside Arrow batches, one page at a time, and never fails on markup."""
