"""Data jobs as DataFrame → DataFrame functions (no session state, no collect)."""
