"""Query registry and its independent SQL counterparts."""
