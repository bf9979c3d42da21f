"""Public wording of licenses: short ones whole, and of long ones the beginning, which stands in every copy of them."""

from __future__ import annotations

# Name and text of each license.
SHORT = [
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
        OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
        altered from any source distribution.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain.
        We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties
        to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software
        and this entire statement, including the above license grant, this restriction and the following disclaimer,
        must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a
        source language processor.""",
    ),
    (
        "WTFPL",
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing
        it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS
        FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
    ),
]

BEGINNINGS = [
    (
        "Apache-2.0",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,
        REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use,
        reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the
        copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall
        mean the union of the acting entity and all other entities that control, are controlled by, or are under common
        control with that entity. For the purposes of this definition, "control" means (i) the power, direct or
        indirect, to cause the direction or management of such entity, whether by contract or otherwise, or (ii)
        ownership of fifty percent (50%) or more of the outstanding shares, or (iii) beneficial ownership of such
        entity. "You" (or "Your") shall mean an individual or Legal Entity exercising permissions granted by this
        License. "Source" form shall mean the preferred form for making modifications, including but not limited to
        software source code, documentation source, and configuration files. "Object" form shall mean any form resulting
        from mechanical transformation or translation of a Source form, including but not limited to compiled object
        code, generated documentation, and conversions to other media types.""",
    ),
    (
        "GPL-2.0",
        """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51
        Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim
        copies of this license document, but changing it is not allowed. Preamble The licenses for most software are
        designed to take away your freedom to share and change it. By contrast, the GNU General Public License is
        intended to guarantee your freedom to share and change free software-- to make sure the software is free for all
        its users. This General Public License applies to most of the Free Software Foundation's software and to any
        other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the
        GNU Lesser General Public License instead.) You can apply it to your programs, too.""",
    ),
    (
        "GPL-3.0",
        """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.
        <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but
        changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and
        other kinds of works. The licenses for most software and other practical works are designed to take away your
        freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your
        freedom to share and change all versions of a program-- to make sure it remains free software for all its users.
        We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also
        to any other work released this way by its authors. You can apply it to your programs, too.""",
    ),
    (
        "LGPL-2.1",
        """GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation,
        Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute
        verbatim copies of this license document, but changing it is not allowed. [This is the first released version of
        the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version
        number 2.1.] Preamble The licenses for most software are designed to take away your freedom to share and change
        it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free
        software-- to make sure the software is free for all its users.""",
    ),
    (
        "LGPL-3.0",
        """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.
        <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but
        changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and
        conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed
        below. 0. Additional Definitions. As used herein, "this License" refers to version 3 of the GNU Lesser General
        Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License.""",
    ),
    (
        "MPL-2.0",
        """Mozilla Public License Version 2.0 1. Definitions -- -- -- -- -- -- -- 1.1. "Contributor" means each individual
        or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor
        Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular
        Contributor's Contribution. 1.3. "Contribution" means Covered Software of a particular Contributor. 1.4.
        "Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A,
        the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including
        portions thereof.""",
    ),
    (
        "Artistic-1.0",
        """The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may
        be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of
        the package, while giving the users of the package the right to use and distribute the Package in a more-or-less
        customary fashion, plus the right to make reasonable modifications. Definitions: "Package" refers to the
        collection of files distributed by the Copyright Holder, and derivatives of that collection of files created
        through textual modification. "Standard Version" refers to such a Package if it has not been modified, or has
        been modified in accordance with the wishes of the Copyright Holder as specified below. "Copyright Holder" is
        whoever is named in the copyright or copyrights for the package.""",
    ),
    (
        "CC0-1.0",
        """CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES.
        DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS
        INFORMATION ON AN "AS-IS" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT OR THE
        INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES RESULTING FROM THE USE OF THIS
        DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER. Statement of Purpose The laws of most jurisdictions
        throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the
        creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database
        (each, a "Work"). Certain owners wish to permanently relinquish those rights to a Work for the purpose of
        contributing to a commons of creative, cultural and scientific works ("Commons") that the public can reliably
        and without fear of later claims of infringement build upon, modify, incorporate in other works, reuse and
        redistribute as freely as possible in any form whatsoever and for any purposes, including without limitation
        commercial purposes. These owners may contribute to the Commons to promote the ideal of a free culture and the
        further production of creative, cultural and scientific works, or to gain reputation or greater distribution for
        their Work in part through the use and efforts of others.""",
    ),
]
