"""Training text of the licence classifier: notices by family, and paragraphs of no family.

The notices are the short, customary statements by which works name their licence, and opening or telling sentences of the
licences themselves; public fixed values. NEIGHBOURS are licences outside the families, which must stay unknown: they share most
words with a family's notices.
"""

from __future__ import annotations

#: Notices by family. %s stands for a year and a name, which training replaces by changing words.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache License 2.0.",
        "Distributed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the 2-clause BSD license.",
    ],
    "cc_by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Content is available under the Creative Commons Attribution 4.0 licence (CC BY 4.0).",
    ],
    "cc_by_nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "The material may be shared and adapted for noncommercial purposes under CC BY-NC 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GPL v3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Distributed under the terms of the MIT license. See the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "This project is MIT licensed.",
    ],
}
#: Notices of licences that are none of the families.
NEIGHBOURS = [
    "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Licensed under the Mozilla Public License, version 2.0.",
    "If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/.",
    "SPDX-License-Identifier: MPL-2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License, Version 2.0.",
    "Licensed under the Eclipse Public License, Version 2.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the GNU Affero General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    "You should have received a copy of the GNU Affero General Public License along with this program.",
    "SPDX-License-Identifier: AGPL-3.0-only",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "Licensed under the GNU Lesser General Public License, version 3.",
    "SPDX-License-Identifier: LGPL-2.1-or-later",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License.",
    "Licensed under CC BY-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Released under CC BY-SA 4.0.",
    "SPDX-License-Identifier: CC-BY-SA-4.0",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Licensed under CC BY-NC-ND 4.0.",
    "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
    "Licensed under CC0 1.0.",
    "SPDX-License-Identifier: CC0-1.0",
    "Licensed under the ISC License.",
    "Released under the ISC license.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "SPDX-License-Identifier: ISC",
    "Released under the Unlicense.",
    "This is free and unencumbered software released into the public domain.",
    "SPDX-License-Identifier: Unlicense",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Academic Free License, version 3.0.",
    "Licensed under the Artistic License, version 2.0.",
    "Licensed under the zlib License.",
    "This software is provided 'as-is', without any express or implied warranty.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the Server Side Public License, version 1.",
    "Licensed under the Business Source License 1.1.",
    "Licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Common Development and Distribution License, Version 1.0.",
    "Licensed under the Python Software Foundation License, version 2.",
    "Licensed under the PostgreSQL License.",
]
#: Sentences of no licence that share words with notices.
ORDINARY = [
    "The driver showed a licence to the officer.", "A fishing license is needed on this river.", "The copyright of the song was sold to a firm.",
    "With the permission of the owner we crossed the field.", "The version was released in spring.", "All rights reserved by the publisher.",
    "Use of the source of water is permitted.", "The general public was free to see the work.", "Terms and conditions of the sale apply.",
    "The warranty ends after two years.", "They licensed the name to a maker of shoes.", "The commons were open for creative play.",
    "A copy of the software was sold with the book.", "The medical board may revoke a license.", "The attribution of the picture is not known.",
    "He studied at MIT for four years.", "She is a student of the MIT media group.", "Der Hund ging mit dem Ball in den Garten.", "Er kam mit der Bahn und ging zu Fuss.",
    "The apache helicopter landed near the river.", "Apache tribes lived in the south of the land.", "The server runs Apache and a database.", "BSD systems boot from this disk.",
    "The by law of the town was changed.", "See section 4.0 of the report for details.", "Version 2.0 of the plan was shown in May.", "Version 3 is better than version 2.",
    "The foundation gave money to the school.", "This program is shown on Sunday.", "The terms of the contract were hard.", "The file was lost.", "You may not use this road in winter.",
    "See the file for details.", "The names of the holders were read aloud.", "The public license office is closed.", "International trade grew by 4 per cent.",
    "The work is free of charge for any person.", "The list of conditions is long.", "Distribution of food in the city went on.", "The creative team got an attribution prize.",
    "La licence du conducteur est perdue.", "La licencia de pesca cuesta poco.", "Die Lizenz zum Fischen ist teuer.", "Under the tree the dog slept.", "An identifier is a name in a program.",
]
#: Everyday words. An n-gram of these alone tells of no licence and is no feature.
EVERYDAY = set(
    """a above accompanying adapted agreed agreement agreements all along an and any are article as associated at available basis be been binary but by
can cited code conditions content copies copy deal derived details disclaimer distribute distributed distribution document documentation either
endorse except express extent fee file files fitness following for form forms found free from general governed have hereby holder hope http https
if implied in included including international is it its kind later law library licensor limitation list made material materials may medium
merge met modify more must name names neither no nor not notice obtain of on one only option or org original other particular permits person portions
possible prior products program programme project promote properly provided public publish published purpose purposes received reproduce reproduction
required restriction retain rights see sell shall shared should software some source specific style subject substantial system terms that the their
this to under unless unrestricted use used useful user version was waived warranties warranty what which who will with without work works writing
written www you your 0 1 2 3 4 5 6 7 8 9""".split()
)
