"""Names and further notices of common SPDX licences, for ``licenses.find_licenses``."""

from __future__ import annotations

# Names of public licences as notices give them; SPDX identifiers are added below.
_PLAIN = {
    "MIT": ["MIT License", "MIT Expat License", "Expat License", "MIT X11 License", "MIT style License"],
    "MIT-0": ["MIT No Attribution License", "MIT No Attribution"],
    "Apache-1.1": ["Apache License 1.1", "Apache License Version 1.1", "Apache Software License 1.1"],
    "Apache-2.0": [
        f"{a}{b}" for a in ("Apache License", "Apache Software License", "Apache Public License", "Apache", "ASL")
        for b in (" 2.0", " 2")
    ] + ["Apache 2.0 License", "Apache 2 License"],
    "BSD-2-Clause": ["BSD 2 Clause License", "2 Clause BSD License", "Simplified BSD License", "FreeBSD License", "two clause BSD License"],
    "BSD-3-Clause": [
        "BSD 3 Clause License", "3 Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License",
        "three clause BSD License", "BSD 3 Clause New or Revised License",
    ],
    "BSD-4-Clause": ["BSD 4 Clause License", "4 Clause BSD License", "Original BSD License"],
    "0BSD": ["Zero Clause BSD License", "BSD Zero Clause License", "0BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License", "zlib libpng License"],
    "BSL-1.0": ["Boost Software License", "Boost Software License Version 1.0", "Boost Software License 1.0", "Boost License 1.0"],
    "Unlicense": ["Unlicense License", "The Unlicense"],
    "WTFPL": ["WTFPL License", "Do What The F ck You Want To Public License", "WTFPL Version 2", "WTFPL v2"],
    "CC0-1.0": [
        "CC0", "CC0 License", "CC0 1.0 Universal", "CC0 1.0 License", "CC0 1.0 Universal License", "Creative Commons Zero",
        "Creative Commons CC0", "Creative Commons CC0 License", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal",
        "Creative Commons CC0 1.0 Universal License", "Creative Commons CC0 1.0 Universal Public Domain Dedication",
        "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero 1.0", "Creative Commons Zero License",
    ],
    "PSF-2.0": ["Python Software Foundation License Version 2", "PSF License Version 2", "Python Software Foundation License 2.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License Version 2.0"],
    "OFL-1.1": ["SIL Open Font License", "SIL Open Font License Version 1.1", "SIL Open Font License 1.1", "Open Font License 1.1"],
    "MS-PL": ["Microsoft Public License", "Microsoft Public License Ms PL"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License", "ODbL", "Open Database License 1.0", "Open Database License v1.0"],
}
_VERSIONED = {
    "MPL": (["Mozilla Public License", "MPL"], ["1.1", "2.0"]),
    "EPL": (["Eclipse Public License", "EPL"], ["1.0", "2.0"]),
    "EUPL": (["European Union Public License", "European Union Public Licence", "EUPL"], ["1.1", "1.2"]),
    "CDDL": (["Common Development and Distribution License", "CDDL"], ["1.0", "1.1"]),
}
_GNU = {
    "GPL": (["GNU General Public License", "GNU GPL", "GPL", "General Public License"], ["1.0", "2.0", "3.0"]),
    "LGPL": (
        ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "Lesser General Public License"],
        ["2.0", "2.1", "3.0"],
    ),
    "AGPL": (["GNU Affero General Public License", "GNU AGPL", "AGPL", "Affero General Public License"], ["3.0"]),
    "GFDL": (["GNU Free Documentation License", "GNU FDL", "GFDL"], ["1.1", "1.2", "1.3"]),
}
_CC_WORDS = {
    "BY": ["Attribution"], "SA": ["ShareAlike", "Share Alike"], "NC": ["NonCommercial", "Non Commercial"],
    "ND": ["NoDerivatives", "NoDerivs", "No Derivatives", "No Derivs"],
}
_CC_PORTS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _numbers(version: str) -> list[str]:
    """1.0 is also 1; ``v`` and ``version`` before a number do not count."""
    return [f" {n}" for n in dict.fromkeys([version, version.removesuffix(".0")])]


def _names() -> dict[str, list[str]]:
    names = {licence: [licence, *known] for licence, known in _PLAIN.items()}
    for short, (known, versions) in _VERSIONED.items():
        for v in versions:
            both = [*known, f"{known[0]} {short}"]
            names[f"{short}-{v}"] = [f"{short}-{v}", *(f"{n}{v2}{end}" for n in both for v2 in _numbers(v) for end in ("", " License"))]
    for short, (known, versions) in _GNU.items():
        for v in versions:
            plain = [f"{n}{v2}" for n in [*known, f"{known[0]} {short}"] for v2 in _numbers(v)]
            names[f"{short}-{v}-only"] = [f"{short}-{v}-only", f"{short}-{v}", *plain, *(f"{n} License" for n in plain), *(f"{n} only" for n in plain)]
            names[f"{short}-{v}-or-later"] = [
                f"{short}-{v}-or-later", *(f"{n} or {later}" for n in plain for later in ("later", "any later version", "at your option any later version", "later version"))
            ]
    for parts in (["BY"], ["BY", "SA"], ["BY", "NC"], ["BY", "ND"], ["BY", "NC", "SA"], ["BY", "NC", "ND"]):
        long = ["Creative Commons"]
        for part in parts:
            long = [f"{a} {b}" for a in long for b in _CC_WORDS[part]]
        short = ["CC " + " ".join(parts), "Creative Commons " + " ".join(parts), "Creative Commons CC " + " ".join(parts)]
        for version, port in _CC_PORTS.items():
            mine = [f"CC-{'-'.join(parts)}-{version}"]
            for name in long + short:
                for v in _numbers(version)[:1]:
                    mine += [f"{name}{v}", f"{name}{v} License", f"{name}{v} {port}", f"{name}{v} {port} License", f"{name}{v} {port} Public License"]
                    mine += [f"{name} License{v}", f"{name} {port} License{v}"]
            names["CC-" + "-".join(parts) + "-" + version] = mine
    # The two that are most often given together.
    pairs = [("MIT", "Apache-2.0"), ("Apache-2.0", "MIT")]
    names["Apache-2.0 OR MIT"] = [
        f"{a} {word} {the}{b}" for x, y in pairs for a in names[x] for b in names[y] for word in ("or", "and") for the in ("", "the ")
    ]
    return names


NAMES = _names()
# Wording of public licence notices.
_GRANT = (
    "{it} free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software"
    " Foundation; either version {v} of the License, or (at your option) any later version."
)
_ONLY = (
    "{it} free software; you can redistribute it and/or modify it under the terms of the {name}{v} as published by the Free Software"
    " Foundation."
)
SENTENCES: dict[str, str] = {
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unl": "This is free and unencumbered software released into the public domain.",
    "cc0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}
RULES: list[tuple[str, list[str]]] = [
    ("MPL-2.0", ["mpl"]), ("EPL-2.0", ["epl"]), ("ISC", ["isc"]), ("ISC", ["isc2"]), ("0BSD", ["0bsd"]), ("Zlib", ["zlib"]),
    ("Unlicense", ["unl"]), ("CC0-1.0", ["cc0"]),
]
for _short, (_known, _versions) in _GNU.items():
    for _v in _versions if _short != "GFDL" else ():
        for _it in ("This program is", "This library is", "This software is", "This file is", "It is"):
            for _n in dict.fromkeys([_v, _v.removesuffix(".0")]):
                _key = f"{_short}{_v}{_it}{_n}"
                SENTENCES[_key] = _GRANT.format(it=_it, v=_n, name=_known[0])
                SENTENCES[_key + "only"] = _ONLY.format(it=_it, v=f" version {_n}", name=_known[0])
                RULES += [(f"{_short}-{_v}-or-later", [_key]), (f"{_short}-{_v}-only", [_key + "only"])]
