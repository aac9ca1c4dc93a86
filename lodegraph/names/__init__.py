"""From textual references to typed edges."""
