import re


def split(text):
    """Words by the fixed white space."""
    return re.findall("[^\x20\x09-\x0d]+", text or "")
