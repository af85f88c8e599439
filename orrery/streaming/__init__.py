"""Tables that streams keep up to date."""
