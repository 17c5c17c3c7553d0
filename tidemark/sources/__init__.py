"""Reading, checking, upserting and logging tables."""
