"""An error-tolerant reader of Rust sources: tokens, items, call sites, local bindings."""
