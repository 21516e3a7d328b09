"""Usual notices of public licenses.

Fixed values: label, notice, and the notice's mark, consecutive words that tell it from the notices of other licenses.
"""

from __future__ import annotations

TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "any person obtaining a copy of this software"),
    ("mit", "Released under the MIT License", "mit license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "any person obtaining a copy of this software",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("apache-2", "You may not use this file except in compliance with the Apache License", "apache license"),
    (
        "apache-2",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
        "unless required by applicable law or agreed to in writing software",
    ),
    ("gpl-3", "Licensed under the GNU General Public License, version 3", "gnu general public license"),
    ("gpl-2", "Licensed under the GNU General Public License, version 2", "gnu general public license"),
    ("gpl", "This program is free software: you can redistribute it under the GNU General Public License", "gnu general public license"),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
        "see the gnu general public license for more details",
    ),
    ("lgpl", "Licensed under the GNU Lesser General Public License", "gnu lesser general public license"),
    ("lgpl-2.1", "Licensed under the GNU Lesser General Public License, version 2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3", "gnu lesser general public license version 3"),
    ("agpl", "Licensed under the GNU Affero General Public License", "gnu affero general public license"),
    ("agpl-3", "Licensed under the GNU Affero General Public License, version 3", "gnu affero general public license version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
        "nor the names of its contributors may be used to endorse",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "for any purpose with or without fee is hereby granted",
    ),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    (
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
        "any person or organization obtaining a copy of the software",
    ),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", "boost software license version 1 0"),
    (
        "epl-2",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "eclipse public license 2 0",
    ),
    ("cddl-1", "The contents of this file are subject to the terms of the Common Development and Distribution License", "common development and distribution license"),
    ("eupl-1.2", "Licensed under the European Union Public Licence, version 1.2", "european union public licence version 1 2"),
    ("artistic-2", "You can redistribute it and/or modify it under the terms of the Artistic License (2.0)", "artistic license 2 0"),
    ("ms-pl", "Licensed under the Microsoft Public License", "microsoft public license"),
    ("ncsa", "Released under the University of Illinois/NCSA Open Source License", "ncsa open source license"),
    ("psf-2", "Licensed under the Python Software Foundation License Version 2", "python software foundation license version 2"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "sil open font license version 1 1"),
    (
        "postgresql",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and "
        "without a written agreement is hereby granted",
        "without a written agreement is hereby granted",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software",
        "in no event will the authors be held liable",
    ),
    ("public-domain", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "waived all copyright and related or neighboring rights",
    ),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike 4 0"),
    ("cc-by-nd", "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "creative commons attribution noderivatives 4 0"),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial 4 0"),
    (
        "cc-by-nc-sa",
        "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        "creative commons attribution noncommercial sharealike 4 0",
    ),
    (
        "cc-by-nc-nd",
        "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
        "creative commons attribution noncommercial noderivatives 4 0",
    ),
    ("cc-by", "Licensed under CC BY 4.0", "cc by 4 0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd 4 0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", "cc by nc nd 4 0"),
)

#: Labels of a license without its version, and those of its versions; the former goes where one of the latter is found.
VERSIONS = {"gpl": ("gpl-2", "gpl-3"), "lgpl": ("lgpl-2.1", "lgpl-3"), "agpl": ("agpl-3",), "bsd": ("bsd-3",)}
