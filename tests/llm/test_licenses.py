import duckdb
from pyspark.sql import functions as F

from rankloom.llm import licenses


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(licenses.SQL).fetchall()
    got = list(map(tuple, licenses.query(spark, sf).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} >= {"Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", "Proprietary"}


def test_inheritance_and_odd_rows(spark):
    rows = [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
        (2, "a/b/c/x.py", "# nothing said"),
        (3, "a/b/COPYING.txt", "This program is licensed under the GNU General Public License, version 2."),
        (4, "a/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (5, "z.py", None),
        (6, None, "All rights reserved."),
        (6, None, ""),
        (7, "ab/LICENSE", "permission slips, and a poem about licence plates on cars of many other colours"),
        (7, "ab/x", "q"),
        (None, "a/b/q", "long " * 30000 + "\nReleased under the MIT License."),
        (8, "a/w", ""),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("unit", F.lit(1)).withColumn("license", F.lit("x"))
    got = {(r.doc_id, r.path): (r.own_license, r.license, r.origin, r.from_dir) for r in licenses.scan(files).collect()}
    assert got == {
        (1, "a/LICENSE"): ("MIT", "MIT", "own", None),
        (2, "a/b/c/x.py"): (None, "GPL-2.0", "inherited", "a/b"),
        (3, "a/b/COPYING.txt"): ("GPL-2.0", "GPL-2.0", "own", None),
        (4, "a/y.py"): ("Apache-2.0", "Apache-2.0", "own", None),
        (5, "z.py"): (None, None, None, None),
        (6, None): got[6, None],
        (7, "ab/LICENSE"): (None, None, None, None),
        (7, "ab/x"): (None, None, None, None),
        (None, "a/b/q"): ("MIT", "MIT", "own", None),
        (8, "a/w"): (None, "MIT", "inherited", "a"),
    }
    assert licenses.scan(files).count() == len(rows)
    assert licenses.scan(files.limit(0)).collect() == []


def test_wrapped_notices(spark):
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met.\n"
    rows = [
        (1, "a/x.py", f"# A tool.\n\n{bsd}\nimport os\n"),
        (2, "a/y.c", "/*\n * This program is licensed under the GNU\n * General Public License,\n * version 2.\n */\nint x;"),
        (3, "a/z.c", "// This program is not\n\n// under any public domain notice\nint y;"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert {r.doc_id: r.own_license for r in licenses.scan(files).collect()} == {1: "BSD-3-Clause", 2: "GPL-2.0", 3: None}


MIT = f"MIT License\n\nCopyright (c) 2021 Jane Roe\n\n{licenses.WHOLE[3][1].split('(c). ', 1)[1]}".replace("conditions: The", "conditions:\n\nThe").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
ISC = "ISC License\n\nCopyright (c) 2019, Someone <a@b.example>\n\n" + licenses.WHOLE[2][1].split("Copyright. ", 1)[1].replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
BSD_2 = f"Copyright (c) 2020, Someone\nAll rights reserved.\n\n{licenses._BSD.replace('met: R', 'met:' + chr(10) + chr(10) + '1. R').replace('. Redis', '.' + chr(10) + chr(10) + '2. Redis')}\n\n{licenses._BSD_AS_IS}"
BSD_3 = BSD_2.replace(f"\n\n{licenses._BSD_AS_IS}", f"\n\n3. {licenses._BSD_NAMES}\n\n{licenses._BSD_AS_IS}")
FILLER = "\n\n".join(f"  {k}. Terms and conditions of the work, its source form and object form, and of each contributor, in section {k} and the others that follow it." for k in range(60))
APACHE = f"                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n{FILLER}"
GPL_3 = f"                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n\n{FILLER}\n\n  13. Use with the GNU Affero General Public License.\n\n{FILLER}\n\nuse the GNU Lesser General Public License instead of this License.\n"
GPL_2 = f"                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n{FILLER}"
LGPL = f"                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n{FILLER}"
AGPL = f"                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n{FILLER}"
MPL = f"Mozilla Public License Version 2.0\n==================================\n\n{FILLER}"


def test_whole_licence_files(spark):
    files = {"MIT": MIT, "ISC": ISC, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "Apache-2.0": APACHE, "GPL-3.0": GPL_3, "GPL-2.0": GPL_2, "LGPL-3.0": LGPL, "AGPL-3.0": AGPL, "MPL-2.0": MPL}
    rows = [(k, f"{k}/LICENSE", t) for k, t in enumerate(files.values())] + [(100 + k, f"{k}/src/x.py", "pass") for k in range(len(files))]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {k: got[k] for k in range(len(files))} == {k: (n, "own") for k, n in enumerate(files)}
    assert {k: got[100 + k] for k in range(len(files))} == {k: (n, "inherited") for k, n in enumerate(files)}


def test_close_licenses_are_told_apart(spark):
    want = {
        "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "// SPDX-License-Identifier: MIT": "MIT", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0", "SPDX-License-Identifier: LGPL-3.0-only": "LGPL-3.0",
        "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: Zlib": None, "SPDX-License-Identifier: Apache-1.1": None, "SPDX-License-Identifier: CC-BY-NC-ND-4.0": None, "SPDX-License-Identifier: MIT OR Apache-2.0": None,
        "Licensed under CC BY-NC-ND 4.0.": None, "Licensed under CC BY-SA 3.0.": None, "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": None,
        "This program is licensed under the GNU General Public License, version 1.": None, "This program is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "Licensed under the Apache License, Version 2.0 (2021).": "Apache-2.0", "Licensed under the Apache License, Version 1.1.": None,
    }
    rows = [(k, f"d{k}/x", f"{t}\n{'code ' * 40}") for k, t in enumerate(want)]
    got = {r.doc_id: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [(t, got[k]) for k, t in enumerate(want)] == list(want.items())
