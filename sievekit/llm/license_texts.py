"""Fixed values of the licence scan: public licence texts and usual notices.

The whole texts are the files of ``licenses``, named by SPDX id. Names of the
table: ``<id>`` and ``<id>-<form>``. Forms: ``text``, the whole text with its
title; ``terms``, the same up to the end of its terms, without the appendix;
``bare``, a short text without its title; ``bullets`` and ``bare-bullets``,
the same with marks instead of numbers; ``title``, ``spdx`` and those of
``NOTICES``: one-line notices.
"""

from __future__ import annotations

import re
from importlib import resources

# Titles, and the names by which one-line notices call a licence.
TITLES = {
    "0BSD": ("BSD Zero Clause License",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPLv3", "AGPL-3.0 License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "Artistic-1.0-Perl": ("Artistic License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC-BY-3.0": ("Creative Commons Attribution 3.0 License", "CC BY 3.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-SA-3.0": ("Creative Commons Attribution-ShareAlike 3.0 License", "CC BY-SA 3.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"),
    "GFDL-1.2": ("GNU Free Documentation License, version 1.2",),
    "GFDL-1.3": ("GNU Free Documentation License, version 1.3",),
    "GPL-1.0": ("GNU General Public License, version 1",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPLv2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPLv3", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.0": ("GNU Library General Public License, version 2",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "MIT": ("MIT License",),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
NOTICES = {
    "licensed": "Licensed under the {}.",
    "licensed-short": "Licensed under {}.",
    "released": "Released under the {}.",
    "distributed": "Distributed under the {}.",
    "work": "This work is licensed under the {}.",
    "project": "This project is licensed under the {}.",
    "software": "This software is licensed under the {}.",
    "license": "License: {}",
    "title": "{}",
}
# Texts whose files have no title, or one that is often left out.
SHORT = ("BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-UC", "Zlib")
END = "END OF TERMS AND CONDITIONS"


def headed(title: str, text: str) -> str:
    return f"{title}\n\n{text}"


def forms(name: str, text: str) -> dict[str, str]:
    """The forms of one whole text."""
    if name not in SHORT:
        out = {f"{name}-text": text}
        if END in text:
            out[f"{name}-terms"] = text[:text.index(END)]
            out[f"{name}-terms-end"] = text[:text.index(END) + len(END)]
        return out
    bullets = re.sub(r"(?m)^(\s*)\d\. ", r"\1* ", text)
    out = {f"{name}-bare": text, f"{name}-bare-bullets": bullets}
    for title in TITLES.get(name, ())[:1]:
        out |= {f"{name}-text": headed(title, text), f"{name}-bullets": headed(title, bullets)}
    return out


def notices() -> dict[str, str]:
    out = {}
    for name, titles in TITLES.items():
        out[f"{name}-spdx"] = f"SPDX-License-Identifier: {name}"
        for form, line in NOTICES.items():
            for k, title in enumerate(titles):
                out[f"{name}-{form}" + (f"-{k + 1}" if k else "")] = line.format(title)
    for name in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        for form in ("only", "or-later"):
            out[f"{name}-{form}-spdx"] = f"SPDX-License-Identifier: {name}-{form}"
    return out


def texts() -> dict[str, str]:
    out = notices()
    for file in resources.files(__package__).joinpath("licenses").iterdir():
        if file.name.endswith(".txt"):
            out |= forms(file.name.removesuffix(".txt"), file.read_text(encoding="utf-8"))
    # the header that the Apache licence asks for, from its appendix
    header = out["Apache-2.0-text"].split("[name of copyright owner]")[1]
    return out | {"Apache-2.0-header": header}
