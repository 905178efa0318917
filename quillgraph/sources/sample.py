"""A small sample archive, made up for the demonstration: a cycling club's map server and its list, one week in May 2011.

It reaches every rule: two votes with answers for and against, one resolved, a bug list, an assignment that is reversed, component names in
bodies and in a subject alone, two people with two addresses, a resent mail, a lightly edited one, an unreadable date, an empty body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_REPORT = "The tour map froze twice on Sunday while sixty riders were loading the hill section at once, and each time only a restart of the server brought the contour layer back for all of them"
#: (id, from_name, from_addr, date, subject, in_reply_to, body)
ROWS = [
    ("ride-a1", "", "olu@cycle.example", "Mon, 2 May 2011 07:15:00 +0100", "Frozen contour layer", None, f"{_REPORT}.\n\nBZ-77 and BZ-80 look alike to me. BZ-77 is not assigned yet.\n\n-- \nolu, ride desk"),
    ("ride-a2", "Ida Brandt", "ida.brandt@cycle.example", "Mon, 2 May 2011 20:40:00 +0200", "Re: Frozen contour layer", "ride-a1", "olu wrote in <ride-a1@cycle.example>:\n> The tour map froze twice\n\nThe worker MPM ran out of threads, see the log.\n\n-- \nIda"),
    ("ride-b1", "Tomas Rey", "tomas@cycle.example", "Tue, 3 May 2011 18:05:00 +0200", "[vote] Short tile addresses", None, "Short addresses need two mod_rewrite rules.\nPlease vote until Friday.\n"),
    ("ride-b2", "Ida Brandt", "ida-brandt@home.example", "Tue, 3 May 2011 22:31:00 +0200", "Re: [vote] Short tile addresses", "ride-b1", "+1, my old links were a mess.\n\n-- \nIda (at home)"),
    ("ride-b3", "Nkem Adler", "nkem@cycle.example", "Wed, 4 May 2011 06:50:00 +0200", "Re: [vote] Short tile addresses", "ride-b1", "-1 before the race, printed maps carry the long ones."),
    ("ride-b4", "Tomas Rey", "rey.t@post.example", "Fri, 6 May 2011 19:00:00 +0200", "Re: [vote] Short tile addresses", "ride-b3", "Resolved: short addresses from June on.\n\n-- \nTomas"),
    ("ride-c1", "Nkem Adler", "nkem@cycle.example", "Thu, 5 May 2011 12:00:00 +0200", "Certificates and mod_ssl", None, f"Olu asked me to pass this on.\n\n{_REPORT}.\nBZ-81 was assigned to Tomas, no longer to Ida."),
    ("ride-c2", "", "olu@cycle.example", "Thu, 5 May 2011 12:30:00 +0100", "Frozen contour layer (again)", None, f"{_REPORT}.\n\nBZ-77 and BZ-80 look alike to me. BZ-77 is not assigned yet.\n\n-- \nsent twice, sorry"),
    ("ride-c3", "", "olu@cycle.example", "some time in May", "Frozen contour layer (edited)", "ride-a1", f"{_REPORT}.\n\nBZ-77 and BZ-80 look alike to me. BZ-77 is not assigned today."),
    ("ride-d1", "Pia Sommer", "pia@cycle.example", "Sat, 7 May 2011 09:00:00 +0200", "[VOTE] Picnic after the race", None, ""),
    ("ride-d2", "Ida Brandt", "ida.brandt@cycle.example", "Sat, 7 May 2011 09:20:00 +0200", "Re: [VOTE] Picnic after the race", "ride-d1", "+1 with cake.\nFrom noon on I can help."),
]
OVERRIDES = {"person_aliases": {"rey.t@post.example": "tomas@cycle.example"}}


def messages(spark: SparkSession) -> DataFrame:
    """The sample as write_mbox() takes it, in one partition."""
    full = lambda x: x and f"<{x}@cycle.example>"
    rows = [(full(i), name, addr, date, subject, full(parent), body) for i, name, addr, date, subject, parent, body in ROWS]
    return spark.createDataFrame(rows, "message_id string, from_name string, from_addr string, date string, subject string, in_reply_to string, body_raw string").coalesce(1)
