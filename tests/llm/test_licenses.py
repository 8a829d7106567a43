"""Licence scan: held-out accuracy on altered notices, and hand-made documents."""

from corvane.llm import license_scan as L

PROSE = "The river bent twice before the mill and nobody could say which bend was older"


def test_held_out_accuracy_and_unknown():
    made = L.altered(seed=5)
    weights = L.fit(made)
    temperature, level = L.calibrate(weights, L.altered(seed=6))
    rows = L.altered(seed=99)
    p = L.log_probabilities(weights, [x for x, _ in rows], temperature)
    right = sum(int(a) == k for a, (_, k) in zip(p.argmax(axis=1), rows))
    assert right >= 0.97 * len(rows) and 0.5 <= level <= 0.95


def test_documents(spark):
    texts = [None, "", "\n \n", PROSE, f"{PROSE}\nReleased under the MIT License.\n{PROSE}", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.",
             "released UNDER the mit license", "A license to drive was granted in version 2.0 of the form.", "word " * 20_000 + "\nThis work is licensed under the GNU General Public License, version 3.",
             "Licensed under CC BY 4.0.", "The MIT campus is old.", "Releasing the public under a licence"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(4, texts[4], "y")], "doc_id long, text string, n_paragraphs string")
    out = L.scan_licenses(df).collect()
    found = {r["doc_id"]: [(h["paragraph"], h["family"]) for h in r["license_hits"] if h["confirmed"]] for r in out}
    assert len(out) == len(texts) + 1
    assert found == {0: [], 1: [], 2: [], 3: [], 4: [(1, "mit")], 5: [(0, "cc-by-nc"), (1, "apache")], 6: [(0, "mit")], 7: [], 8: [(1, "gpl")], 9: [(0, "cc-by")], 10: [], 11: []}
    assert {r["doc_id"]: r["n_paragraphs"] for r in out}[4] == 3
    assert L.scan_licenses(df.where("false")).count() == 0


def test_wrapped_notices(spark):
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:"""
    mit = """// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, including without limitation the rights"""
    apache = """Licensed under the Apache
License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License."""
    narrow = "This program is free software:\nyou can redistribute it and/or\nmodify it under the terms of\nthe GNU General Public License."
    torn = gpl.replace("\n", "\n\n")
    texts = [f"{PROSE}\n{gpl}\n{PROSE}", bsd, f"{PROSE}\n\n{mit}", apache, narrow, torn, f"{PROSE}\n{PROSE}", f"{'word ' * 5000}\n{bsd}\n\n{mit}"]
    out = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: [(h["paragraph"], h["family"]) for h in r["license_hits"] if h["confirmed"]] for r in out}
    assert found == {0: [(1, "gpl")], 1: [(0, "bsd")], 2: [(1, "mit")], 3: [(0, "apache")], 4: [(0, "gpl")], 5: [], 6: [], 7: [(1, "bsd"), (3, "mit")]}
