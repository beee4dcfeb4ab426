"""The word pattern that brute-force versions share."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
