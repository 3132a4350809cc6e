"""DataFrame operators over series in canonical long form."""
