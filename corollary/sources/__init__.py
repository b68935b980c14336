"""Knowledge bases: loading, saving, encoding."""
