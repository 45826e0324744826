"""Titles, headers and statements of licences, by SPDX identifier, as they stand in files under them. All are fixed values."""

from __future__ import annotations

_FREE = "is free software; you can redistribute it and/or modify it under the terms of the GNU"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(name: str, version: str, title: str, dated: str) -> tuple[str, ...]:
    """A GNU licence's title, with its date and without, its headers, and statements by its initials."""
    short = "".join(w[0] for w in name.replace("GNU", "").split())
    header = lambda what: f"This {what} {_FREE} {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    return (
        f"{title} Version {version}, {dated}", f"{name}, version {version}", header("program"), header("library"),
        f"This work is licensed under the {name}, version {version}.",
        f"You should have received a copy of the {name} along with this program. Licensed under the {name}, version {version} or later.",
        f"Licensed under the {short}v{version} or later.", f"Licensed under {short}v{version}", f"Licensed under the {short}, version {version}", f"License: {short}-{version}", f"License: {short}v{version}",
    )


def _creative(kind: str, version: str, name: str) -> tuple[str, ...]:
    return (
        f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {name} {version} International License.", f"Creative Commons {name} {version} International Public License",
        f"https://creativecommons.org/licenses/{kind.lower()}/{version}/ license",
    )


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {n}" for n in names)


RESERVED_NAME, RESERVED_LINE = "LicenseRef-Proprietary", "All rights reserved."

TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (*_gnu("GNU Affero General Public License", "3", "GNU AFFERO GENERAL PUBLIC LICENSE", "19 November 2007"), *_spdx("AGPL-3.0-only", "AGPL-3.0-or-later")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        *_spdx("Apache-2.0"),
    ),
    "Artistic-1.0": ('The "Artistic License"', *_spdx("Artistic-1.0-Perl")),
    "BSD-2-Clause": (_BSD, "Use of this source code is governed by the BSD 2-Clause License.", "BSD 2-Clause License", *_spdx("BSD-2-Clause")),
    "BSD-3-Clause": (f"{_BSD} 3. {_ENDORSE}", _ENDORSE, "Use of this source code is governed by a BSD-style license.", "BSD 3-Clause License", *_spdx("BSD-3-Clause")),
    "CC-BY-4.0": _creative("BY", "4.0", "Attribution"),
    "CC-BY-NC-4.0": _creative("BY-NC", "4.0", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _creative("BY-SA", "4.0", "Attribution-ShareAlike"),
    "CC0-1.0": (
        "CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal", *_spdx("CC0-1.0"),
    ),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", *_spdx("EPL-2.0")),
    "GFDL-1.2": ("GNU Free Documentation License Version 1.2, November 2002", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2"),
    "GFDL-1.3": ("GNU Free Documentation License Version 1.3, 3 November 2008", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3"),
    "GPL-1.0": ("GNU GENERAL PUBLIC LICENSE Version 1, February 1989", *_spdx("GPL-1.0-only")),
    "GPL-2.0": (*_gnu("GNU General Public License", "2", "GNU GENERAL PUBLIC LICENSE", "June 1991"), *_spdx("GPL-2.0-only", "GPL-2.0-or-later")),
    "GPL-3.0": (*_gnu("GNU General Public License", "3", "GNU GENERAL PUBLIC LICENSE", "29 June 2007"), *_spdx("GPL-3.0-only", "GPL-3.0-or-later")),
    "ISC": (
        "ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        *_spdx("ISC"),
    ),
    "LGPL-2.0": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", f"This library {_FREE} Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", *_spdx("LGPL-2.0-only", "LGPL-2.0-or-later")),
    "LGPL-2.1": (*_gnu("GNU Lesser General Public License", "2.1", "GNU LESSER GENERAL PUBLIC LICENSE", "February 1999"), *_spdx("LGPL-2.1-only", "LGPL-2.1-or-later")),
    "LGPL-3.0": (*_gnu("GNU Lesser General Public License", "3", "GNU LESSER GENERAL PUBLIC LICENSE", "29 June 2007"), *_spdx("LGPL-3.0-only", "LGPL-3.0-or-later")),
    RESERVED_NAME: (RESERVED_LINE,),
    "MIT": (
        "Released under the MIT License.", "The MIT License (MIT)", "MIT License", "Licensed under the MIT license.", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", *_spdx("MIT"),
    ),
    "MPL-1.1": (
        "MOZILLA PUBLIC LICENSE Version 1.1",
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/', *_spdx("MPL-1.1"),
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", *_spdx("MPL-2.0"),
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "The Unlicense", *_spdx("Unlicense")),
}

#: Words that name a licence: a unit must have those of a template.
NAMES = frozenset(
    "affero agpl agplv apache artistic attribution bsd commons creative documentation eclipse endorse gnu gpl gplv isc lesser lgpl lgplv library mit mozilla noncommercial sharealike unlicense cc nc sa".split()
)
#: Words that make another licence of a name: a unit that has one is none of a template without it.
MODIFIERS = frozenset("affero lesser nc nd noderivatives noderivs noncommercial sa sharealike".split())
#: SPDX identifiers in small letters, and our names of their licences: those of the templates, and those with a plus.
SPDX_IDS = {i.lower(): name for name, ts in TEMPLATES.items() for i in [name, f"{name}+", *(t.rpartition(": ")[2] for t in ts if t.startswith("SPDX-"))] if name != RESERVED_NAME}
