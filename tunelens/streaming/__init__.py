"""Incremental learners run test-then-train over batch replays and micro-batches."""
